"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct k-word shingles. Documents with equal sets form
one class; all work below is on classes, so that copies are never paired.

Tiles. Sizes fall into classes (each CLASS_RATIO wide); for the pairs whose larger
member is in a size class, both sets are cut by hash into more groups than
shingles can differ. So at least one group has the same content in both, and only
sets with such a group in common meet. Groups are chosen so many that this holds
for a group with content, too; a set with too many empty groups is also filed
under its empty ones, which is enough, as only two such sets could miss each other.

Bounds. A set's count vector (shingles per hash group) is a point; the sum of
coordinate minima of two points bounds the overlap of their sets. Two sets of a
tile whose bound reaches the overlap that the threshold asks for may link. Such
edges join sets into clusters: first between each set and one hub of its tile,
then, in tiles that still hold several clusters, by searches in an R-tree over the
points, whose nodes keep the upper corner of what is below them. A tile gives at
most one edge for each of its members.

Links. The whole sets of a cluster are fetched once and searched through the same
tree; each pair that it leaves between two components is verified exactly, and a
link merges them. So a cluster, too, gives at most one link for each member, and
no link between different components is lost. Clusters and tiles of more than LIMIT
weight are dealt in blocks: first all blocks against one, then, by the components
found, pairs of blocks between which components differ.

No text or no words: an empty set, linked with nothing. Fewer words than k: the
whole sequence is the one shingle. Repeated rows are copies. Null doc_id: its
class counts, the row's component is its class's. Extra columns are ignored. Very
long texts are one chunk each. An empty table gives no row. Equal sets are told by
128 bits, shingles of a pair of sets by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, Scratch, Words, gram_hash, lean, mix, random_words, text_chunks, tune
from .components import connected_components

#: Count vectors: shingles per group at most, and the least and most groups.
PER_GROUP, LEAST_GROUPS, MOST_GROUPS = 4, 64, 8192
#: Groups of a tree's points at most, and members of one of its leaves.
VECTOR, LEAF = 2048, 16
#: Rows of complete units of tiles that are searched in one numpy pass.
ROWS = 4096
#: Members of a tile that search its tree at once.
QUERIES = 64
#: Bytes of minima that a search holds at once: they stay in a core's cache.
BLOCK = 1 << 20
#: Weight of one task's group: shingles of a cluster's sets, bytes of a tile's vectors. Larger ones are dealt in blocks of half of it.
LIMIT = 2 << 20
#: Sets whose places may be broadcast to fetch them; more are joined by a shuffle.
FETCH = 500_000
_SALT = random_words(5, 77)


class Plan:
    """Size classes and group counts for links at num / den of the union."""

    def __init__(self, k: int, num: int, den: int) -> None:
        self.k, self.num, self.den = k, num, den
        self.start = [1]

    def _grow(self, n: int) -> None:
        while self.start[-1] <= n:
            s = self.start[-1]
            self.start.append(s * self.den * self.den // (self.num * self.num) + 1)

    def partners(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last size class of the larger member, over all sets that sets of sizes n may link with."""
        most = n * self.den // self.num
        self._grow(int(most.max(initial=1)) + 1)
        return np.searchsorted(self.start, n, "right") - 1, np.searchsorted(self.start, most, "right") - 1

    def groups(self, i: int) -> tuple[int, int]:
        """(groups, empty groups that may be left out) for size class i."""
        self._grow(self.start[-1])
        largest = self.start[i + 1] - 1
        differ = 2 * largest * (self.den - self.num) // (self.den + self.num)
        spare = 0 if differ == 0 else 2 + ceil(0.05 * differ)
        return differ + 1 + spare, spare


def sets_of(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, offsets by text)."""
    w = Words(data, off, NONSPACE)
    at, h = w.grams(k)
    row = w.row[at]
    words = np.diff(w.bounds)
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        extra = [gram_hash([w.hash[0][w.bounds[r] + i: w.bounds[r] + i + 1] for i in range(words[r])])[0] for r in short]
        row, h = np.concatenate([row, short]), np.concatenate([h, np.array(extra, np.uint64)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(off)))


def class_of(h: np.ndarray, off: np.ndarray, clashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes per set, free of order; where the first is one of clashes, which unequal sets share, the second goes into it."""
    n = np.diff(off)
    out = []
    for salt in (_SALT[0], _SALT[4]):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ salt), out=total[1:])
        out.append(mix(total[off[1:]] - total[off[:-1]] + n.astype(np.uint64)))
    if len(clashes):
        out[0] = np.where(np.isin(out[0].view(np.int64), clashes), mix(out[0] ^ out[1] ^ _SALT[1]), out[0])
    return out[0], out[1]


def tile_keys(h: np.ndarray, off: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of all tiles of non-empty sets; set i is h[off[i]:off[i + 1]]."""
    n = np.diff(off)
    first, last = plan.partners(n)
    owner = np.repeat(np.arange(len(n)), last - first + 1)
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    size_class = first[owner] + nth
    groups, spare = np.array([plan.groups(i) for i in range(int(size_class.max(initial=0)) + 1)]).T
    g, m = groups[size_class], n[owner]
    base, begun = np.cumsum(g) - g, np.cumsum(m) - m
    at = np.repeat(off[:-1][owner] - begun, m) + np.arange(m.sum())
    place = (mix(h + _SALT[1])[at] % np.repeat(g, m).astype(np.uint64)).astype(np.int64) + np.repeat(base, m)
    content = np.zeros(g.sum(), np.uint64)
    np.add.at(content, place, mix(h ^ _SALT[2])[at])
    held = np.zeros(len(content), bool)
    held[place] = True
    pair = np.repeat(np.arange(len(owner)), g)
    name = mix((np.arange(len(content)) - base[pair]).astype(np.uint64) + (size_class[pair].astype(np.uint64) << np.uint64(40)))
    used = np.flatnonzero(held)
    bare = g - np.bincount(pair[used], minlength=len(g)) > spare[size_class]
    empty = np.flatnonzero(~held & bare[pair])
    keys = np.concatenate([mix(content[used] + name[used]), mix(name[empty] ^ _SALT[3])])
    return owner[pair[np.concatenate([used, empty])]], keys


def count_vectors(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Per set, shingles by hash group in as many groups as its size calls for, a power of two; 255 stands for at least as many."""
    n = np.diff(off)
    groups = np.clip(1 << np.ceil(np.log2(np.maximum(n / PER_GROUP, 1))).astype(np.int64), LEAST_GROUPS, MOST_GROUPS)
    base = np.concatenate([[0], np.cumsum(groups)])
    place = np.repeat(base[:-1], n) + (mix(h ^ _SALT[3]) & np.repeat(groups - 1, n).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=base[-1]), 255).astype(np.uint8).tobytes()
    return [counts[i:j] for i, j in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _scan(k: int, clashes: np.ndarray):
    """Rows (doc_id, n, cid, other, vec) of all documents."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, off in text_chunks(b.column(1)):
                h, so = sets_of(data, off, k)
                n = np.diff(so)
                cid, other = class_of(h, so, clashes)
                columns = [b.column(0).slice(first, len(n)), pa.array(n), *(pa.array(c.view(np.int64), mask=n == 0) for c in (cid, other)), pa.array(count_vectors(h, so), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "cid", "other", "vec"])

    return run


def _file(plan: Plan, clashes: np.ndarray):
    """Rows (key, cid) of each class once per partition."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, data, off in text_chunks(b.column(0)):
                h, so = sets_of(data, off, plan.k)
                cid, _ = class_of(h, so, clashes)
                fresh = np.zeros(len(cid), bool)
                for r in np.flatnonzero(np.diff(so)):
                    c = int(cid[r])
                    fresh[r] = c not in seen
                    seen.add(c)
                if not fresh.any():
                    continue
                n = np.diff(so)
                h = h[np.repeat(fresh, n)]
                of, keys = tile_keys(h, np.concatenate([[0], np.cumsum(n[fresh])]), plan)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(cid[fresh][of].view(np.int64))], names=["key", "cid"])

    return run


@lean
def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: (key, hub, cid) of the keys that several classes share; the hub comes first."""
    key = cid = hub = None

    def out(k, h, c):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(c)], names=["key", "hub", "cid"])

    for b in batches:
        k, c = np.asarray(b.column(0)), np.asarray(b.column(1))
        if key is not None:
            k, c = np.concatenate([[key], k]), np.concatenate([[cid], c])
        if not len(k):
            continue
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        start = np.ones(len(k), bool)
        start[1:] = k[1:] != k[:-1]
        began = np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
        h = c[began]
        h[began == 0] = c[0] if hub is None else hub
        other = fresh & (c != h)
        if key is not None:
            other[0] = False  # given out with the batch before
        where = np.flatnonzero(other)
        if len(where):
            yield out(k[where], h[where], c[where])
        key, cid, hub = k[-1], c[-1], h[-1]


def _sets(k: int, clashes: np.ndarray, names: list[str]):
    """Rows (shingles and the columns beside the text) of the documents whose set is of the class that is asked for."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = np.asarray(b.column(names.index("cid")))
            for first, data, off in text_chunks(b.column(names.index("text"))):
                h, so = sets_of(data, off, k)
                cid, _ = class_of(h, so, clashes)
                n = np.diff(so)
                good = (n > 0) & (cid.view(np.int64) == want[first:first + len(n)])
                if not good.any():
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[good])]).astype(np.int32)), pa.array(h[np.repeat(good, n)].view(np.int64)))
                beside = [b.column(i).slice(first, len(n)).filter(pa.array(good)) for i, c in enumerate(names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*beside, lists], names=[*(c for c in names if c != "text"), "shingles"])

    return run


def least_overlap(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap with which sets of sizes n and m link."""
    return -(-num * (n + m) // (num + den))


def _vectors(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of count vectors."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset:]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8), off


def _may_link(x: tuple[np.ndarray, np.ndarray], i: np.ndarray, y: tuple[np.ndarray, np.ndarray], j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For pairs of vectors x[i], y[j], whether the sum of minima reaches least; vectors of unequal lengths are folded, saturated groups bound nothing."""
    (a, off_a), (b, off_b) = x, y
    p, q = off_a[i + 1] - off_a[i], off_b[j + 1] - off_b[j]
    ok = np.zeros(len(i), bool)
    for u, v in {*zip(p.tolist(), q.tolist(), strict=True)}:
        same = np.flatnonzero((p == u) & (q == v))
        for rows in np.array_split(same, -(-len(same) * max(u, v) // (4 << 20))):
            first, second = a[off_a[i[rows]][:, None] + np.arange(u)], b[off_b[j[rows]][:, None] + np.arange(v)]
            full = (first == 255).any(1) | (second == 255).any(1)
            first, second = (m if m.shape[1] == min(u, v) else m.reshape(len(rows), -1, min(u, v)).sum(1, dtype=np.int32) for m in (first, second))
            ok[rows] = full | (np.minimum(first, second).sum(1, dtype=np.int64) >= least[rows])
    return ok


def _bounded(num: int, den: int):
    """Of pairs with both count vectors, those that the sum of minima leaves."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            least = least_overlap(np.asarray(b.column(2)), np.asarray(b.column(3)), num, den)
            at = np.arange(b.num_rows)
            ok = pa.array(_may_link(_vectors(b.column(4)), at, _vectors(b.column(5)), at, least))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return run


def _overlaps(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps of points x[i] and y[j], a cache's worth at a time."""
    out = np.empty(len(i), np.uint32)
    step = max(1, BLOCK // (x.shape[1] * x.itemsize))
    for a in range(0, len(i), step):
        out[a:a + step] = np.minimum(x[i[a:a + step]], y[j[a:a + step]]).sum(1, dtype=np.uint32)
    return out


def _all_overlaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps of all points x with all points y, a cache's worth at a time."""
    out = np.empty((len(x), len(y)), np.uint32)
    step = max(1, BLOCK // (x.size * x.itemsize))
    for a in range(0, len(y), step):
        out[:, a:a + step] = np.minimum(x[:, None], y[None, a:a + step]).sum(2, dtype=np.uint32)
    return out


class CountTree:
    """A packed R-tree over count vectors; its nodes keep upper corners and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        leaves: list[np.ndarray] = []

        def split(rows: np.ndarray) -> None:
            if len(rows) <= LEAF:
                leaves.append(rows)
                return
            x = points[rows]
            order = np.argsort(x[:, x.var(0).argmax()], kind="stable")
            half = -(-len(rows) // LEAF) // 2 * LEAF
            split(rows[order[:half]])
            split(rows[order[half:]])

        split(np.arange(len(points)))
        self.leaves = leaves
        upper = np.stack([points[r].max(0) for r in leaves])
        least = np.array([sizes[r].min() for r in leaves])
        self.levels.append((upper, least))
        while len(upper) > LEAF:
            cuts = np.arange(0, len(upper), LEAF)
            upper = np.maximum.reduceat(upper, cuts, axis=0)
            least = np.minimum.reduceat(least, cuts)
            self.levels.append((upper, least))

    def pairs(self, q: np.ndarray, n: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all rows that search() gives for each of the points q, many queries at a time."""
        order, size = np.concatenate(self.leaves), np.array([len(r) for r in self.leaves])
        start = np.cumsum(size) - size
        top = len(self.levels[-1][0])
        for a in range(0, len(q), QUERIES):
            i = np.repeat(np.arange(a, min(a + QUERIES, len(q))), top)
            node = np.arange(len(i)) % top
            for depth in range(len(self.levels) - 1, -1, -1):
                upper, least = self.levels[depth]
                keep = _overlaps(upper, node, q, i) >= least_overlap(n[i], least[node], num, den)
                i, node = i[keep], node[keep]
                if depth:
                    i, node = np.repeat(i, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                    inside = node < len(self.levels[depth - 1][0])
                    i, node = i[inside], node[inside]
            met = np.unique(node)  # leaves that some query reaches
            rows = order[np.repeat(start[met] - np.cumsum(size[met]) + size[met], size[met]) + np.arange(int(size[met].sum()))]
            mine = np.arange(a, min(a + QUERIES, len(q)))
            for part in np.array_split(rows, -(-len(rows) // 4096)) if len(rows) else ():
                overlap = _all_overlaps(q[mine], self.points[part])
                x, y = np.nonzero(overlap >= least_overlap(n[mine][:, None], self.sizes[part][None], num, den))
                yield mine[x], part[y]

    def search(self, q: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Rows whose overlap with the point q of size n may reach the threshold."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            nodes = nodes[np.minimum(upper[nodes], q).sum(1, dtype=np.int64) >= least_overlap(np.int64(n), least[nodes], num, den)]
            if depth:
                below = len(self.levels[depth - 1][0])
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < below]
        if not len(nodes):
            return nodes
        rows = np.concatenate([self.leaves[i] for i in nodes])
        return rows[np.minimum(self.points[rows], q).sum(1, dtype=np.int64) >= least_overlap(np.int64(n), self.sizes[rows], num, den)]


def _points(vectors: list[bytes]) -> np.ndarray:
    """Count vectors of one tile, folded to as many groups as the shortest has; saturated groups bound nothing."""
    groups = min(VECTOR, *map(len, vectors))
    out = np.empty((len(vectors), groups), np.uint16)
    for size in set(map(len, vectors)):
        rows = [i for i, v in enumerate(vectors) if len(v) == size]
        x = np.frombuffer(b"".join(vectors[i] for i in rows), np.uint8).reshape(len(rows), -1, groups)
        out[rows] = np.where((x == 255).any(1), 65535, x.sum(1, dtype=np.uint16) if x.shape[1] > 1 else x[:, 0])
    return out.astype(np.uint8) if out.max() < 256 else out


class _Merged:
    """Components of a task's members, and how they were merged."""

    def __init__(self, cid: np.ndarray, root: np.ndarray) -> None:
        _, first, self.label = np.unique(root, return_index=True, return_inverse=True)
        #: One member of each component as it was at first, and the label it has now.
        self.first, self.now = cid[first], np.arange(len(first))

    def other(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Those of rows that are not in the component of row i."""
        return rows[self.now[self.label[rows]] != self.now[self.label[i]]]

    def merge(self, i: int, rows: np.ndarray) -> None:
        """Join the components of rows with that of row i."""
        self.now[np.isin(self.now, np.unique(self.now[self.label[rows]]))] = self.now[self.label[i]]

    def table(self) -> pa.Table:
        """Edges (a, b) from the merged components to the least of them."""
        order = np.lexsort((self.first, self.now))
        now, first = self.now[order], self.first[order]
        new = np.ones(len(now), bool)
        new[1:] = now[1:] != now[:-1]
        least = first[np.flatnonzero(new)][np.cumsum(new) - 1]
        return pa.table({"a": pa.array(first[~new], pa.int64()), "b": pa.array(least[~new], pa.int64())})


def _search(cid, root, n, side, points, num: int, den: int, check=None) -> pa.Table:
    """Edges that join the components of one unit: for each row of the upper side, those that the tree over the lower side leaves and check keeps."""
    found = _Merged(cid, root)
    upper = side == side.max()
    theirs = np.arange(len(cid)) if upper.all() else np.flatnonzero(~upper)
    mine = np.flatnonzero(upper)
    tree = CountTree(points[theirs], n[theirs])
    if check is None:
        for i, rows in tree.pairs(points[mine], n[mine], num, den):
            i, rows = mine[i], theirs[rows]
            apart = found.label[i] != found.label[rows]
            for x, y in zip(i[apart].tolist(), rows[apart].tolist(), strict=True):
                if found.now[found.label[x]] != found.now[found.label[y]]:
                    found.merge(x, np.array([y]))
        return found.table()
    for i in mine.tolist():
        rows = found.other(i, theirs[tree.search(points[i], int(n[i]), num, den)])
        if len(rows) and len(rows := check(i, rows)):
            found.merge(i, rows)
    return found.table()


def _small_edges(cid, root, n, side, start, size, two, vectors, num: int, den: int) -> list[tuple[int, int]]:
    """Edges of all tiles that fit a leaf: of each, the pairs that the bound leaves between components, as far as they join something."""
    rows = np.concatenate([np.arange(a, a + m) for a, m in zip(start, size, strict=True)]) if len(start) else np.zeros(0, np.int64)
    end, unit = np.repeat(start + size, size), np.repeat(np.arange(len(start)), size)
    after = end - rows - 1
    i = np.repeat(rows, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    of = np.repeat(unit, after)
    good = (root[i] != root[j]) & (~two[of] | (side[i] != side[j])) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
    i, j, of = i[good], j[good], of[good]
    ok = _may_link(vectors, i, vectors, j, least_overlap(n[i], n[j], num, den))
    above: dict[tuple[int, int], int] = {}

    def top(u: int, r: int) -> int:
        while (r2 := above.get((u, r), r)) != r:
            r = r2
        return r

    out = []
    for u, x, y in zip(of[ok].tolist(), i[ok].tolist(), j[ok].tolist(), strict=True):
        p, q = top(u, int(root[x])), top(u, int(root[y]))
        if p != q:
            above[u, max(p, q)] = min(p, q)
            out.append((int(cid[x]), int(cid[y])))
    return out


def _tile_edges(num: int, den: int):
    """Of units of tiles, sorted by unit, edges between components whose sets may link."""

    def run_of(table: pa.Table) -> pa.RecordBatch:
        cid, root, n, side = (np.asarray(table.column(c)) for c in ("cid", "root", "n", "side"))
        two, new = np.zeros(len(cid), bool), np.ones(len(cid), bool)
        units = _unit_columns(table)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in units])
        two = (units[1] != units[3]) | (units[2] != units[4])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(cid)))
        vec = table.column("vec").combine_chunks()
        small = size <= LEAF
        out = _small_edges(cid, root, n, side, start[small], size[small], two[start[small]], _vectors(vec), num, den)
        a, b = zip(*out, strict=True) if out else ((), ())
        parts = [pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})]
        for u, m in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
            of = slice(u, u + m)
            parts.append(_search(cid[of], root[of], n[of], side[of], _points(vec.slice(u, m).to_pylist()), num, den))
        return pa.concat_tables(parts).combine_chunks().to_batches()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            units = _unit_columns(table)
            ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in units]))
            if len(ends):
                yield from run_of(table.slice(0, int(ends[-1]) + 1))
                held = table.slice(int(ends[-1]) + 1).to_batches()
        if held:
            yield from run_of(pa.Table.from_batches(held))

    return run


def _unit_columns(table: pa.Table) -> list[np.ndarray]:
    """key, lo.of, lo.i, hi.of, hi.i of a table of tiles' units."""
    lo, hi = (table.column(c).combine_chunks() for c in ("lo", "hi"))
    return [np.asarray(table.column("key")), *(np.asarray(x.field(i)) for x in (lo, hi) for i in (0, 1))]


def _cluster_links(num: int, den: int):
    """Of one unit of a cluster, verified links between components."""

    def run(table: pa.Table) -> pa.Table:
        cid, root, side = (np.asarray(table.column(c)) for c in ("cid", "root", "side"))
        col = table.column("shingles").combine_chunks()
        n = np.asarray(col.value_lengths()).astype(np.int64)
        _, once = np.unique(cid, return_index=True)
        if len(once) < len(cid):  # rows that share a doc_id and a set
            table = table.take(pa.array(once))
            return run(table)
        flat = np.asarray(col.flatten())
        off = np.concatenate([[0], np.cumsum(n)])
        names, flat_ids = np.unique(flat, return_inverse=True)
        groups = int(np.clip(1 << int(np.ceil(np.log2(2 * max(np.median(n), 1)))), LEAST_GROUPS, max(LEAST_GROUPS, min(VECTOR, (16 << 20) // len(n)))))
        place = np.repeat(np.arange(len(n)) * groups, n) + (mix(flat.view(np.uint64) ^ _SALT[3]) % np.uint64(groups)).astype(np.int64)
        points = np.bincount(place, minlength=len(n) * groups).reshape(len(n), groups)
        points = points.astype(np.uint8 if points.max() < 256 else np.int32)
        held = np.zeros(len(names), bool)

        def check(i: int, rows: np.ndarray) -> np.ndarray:
            own = flat_ids[off[i]:off[i + 1]]
            held[own] = True
            sizes = n[rows]
            begun = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) + np.repeat(off[rows] - begun, sizes)
            overlap = np.add.reduceat(held[flat_ids[at]].astype(np.int64), begun)
            held[own] = False
            return rows[overlap >= least_overlap(n[i], sizes, num, den)]

        return _search(cid, root, n, side, points, num, den, check)

    return run


def _units(rows: DataFrame, group: str, weight: Column, scratch: Scratch, name: str) -> DataFrame:
    """rows (with cid and root) with the unit (lo, hi, side) of their group that a task takes, once for each such unit.

    A group of at most LIMIT weight is one unit. Of others, components of more
    than half of it get blocks of their own, smaller ones share blocks; pairs of
    blocks of the same component, which has nothing to join, are left out.
    """
    zero = F.struct(F.lit(0).cast("long").alias("of"), F.lit(0).alias("i"))
    sizes = rows.groupBy(group).agg(F.sum(weight).alias("w")).where(F.col("w") > LIMIT).select(F.col(group).alias("g"))
    sizes = scratch.table(sizes, f"{name}-large")
    plain = [F.col(c) for c in rows.columns]
    if sizes.isEmpty():
        return rows.select(*plain, zero.alias("lo"), zero.alias("hi"), F.lit(0).alias("side"))
    small = rows.join(sizes, F.col(group) == F.col("g"), "left_anti").select(*plain, zero.alias("lo"), zero.alias("hi"), F.lit(0).alias("side"))
    large = rows.join(sizes, F.col(group) == F.col("g"), "left_semi")
    half = LIMIT // 2
    part = large.groupBy(F.col(group).alias("g"), F.col("root").alias("r")).agg(F.sum(weight).alias("w"))
    part = part.withColumn("heavy", F.col("w") > half)
    light = part.where("not heavy").groupBy("g").agg(F.ceil(F.sum("w") / half).cast("int").alias("m")).withColumnRenamed("g", "lg")
    heavy = part.where("heavy").select(F.col("g").alias("hg"), "r", F.ceil(F.col("w") / half).cast("int").alias("m"))
    own = large.join(heavy, (F.col(group) == F.col("hg")) & (F.col("root") == F.col("r")))
    own = own.select(*plain, F.struct(F.col("root").alias("of"), F.pmod(F.xxhash64("cid"), F.col("m")).cast("int").alias("i")).alias("block"), F.lit(True).alias("one"))
    rest = large.join(heavy, (F.col(group) == F.col("hg")) & (F.col("root") == F.col("r")), "left_anti").join(light, F.col(group) == F.col("lg"))
    rest = rest.select(*plain, F.struct(F.lit(0).cast("long").alias("of"), F.pmod(F.xxhash64("root"), F.col("m")).cast("int").alias("i")).alias("block"), F.lit(False).alias("one"))
    dealt = scratch.table(own.unionByName(rest), f"{name}-dealt")
    blocks = dealt.select(F.col(group).alias("g"), "block", "one").distinct()
    a, b = (blocks.toDF(f"g{s}", f"b{s}", f"o{s}") for s in "xy")
    pairs = a.join(b, (F.col("gx") == F.col("gy")) & (F.col("bx") <= F.col("by"))).where(~(F.col("ox") & F.col("oy") & (F.col("bx.of") == F.col("by.of"))))
    pairs = pairs.select("gx", F.col("bx").alias("lo"), F.col("by").alias("hi"))
    sides = pairs.select("gx", "lo", "hi", F.col("hi").alias("mine"), F.lit(1).alias("side")).union(pairs.where("lo <> hi").select("gx", "lo", "hi", F.col("lo").alias("mine"), F.lit(0).alias("side")))
    spread = dealt.join(sides, (F.col(group) == F.col("gx")) & (F.col("block") == F.col("mine"))).select(*plain, "lo", "hi", "side")
    return small.unionByName(spread)


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links at den * overlap >= num * union."""
    spark = tune(docs.sparkSession)
    plan, scratch = Plan(k, num, den), Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("d", F.coalesce("doc_id", F.lit(-1)))

    def scanned(clashes: np.ndarray, name: str) -> DataFrame:
        return scratch.table(docs.select("doc_id", "text").mapInArrow(_scan(k, clashes), "doc_id long, n long, cid long, other long, vec binary"), name)

    clashes = np.zeros(0, np.int64)
    base = scanned(clashes, "base")
    twice = base.where("cid is not null").groupBy("cid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
    clashes = np.array([r.cid for r in twice.select("cid").collect()], np.int64)  # about n * n / 2**65 of n sets
    if len(clashes):
        base = scanned(clashes, "base-again")
    classes = base.where("cid is not null").groupBy("cid").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("place"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("vec").alias("vec"))
    classes = scratch.table(classes, "classes")
    keys = docs.select("text").mapInArrow(_file(plan, clashes), "key long, cid long")
    keys = keys.repartition("key").sortWithinPartitions("key", F.xxhash64("cid"), "cid")
    tiles = scratch.table(keys.mapInArrow(_hubs, "key long, hub long, cid long"), "tiles")

    # sets that may link, by the bound: each with its hub, then within tiles of several clusters
    star = tiles.select(F.greatest("hub", "cid").alias("a"), F.least("hub", "cid").alias("b")).distinct()
    a, b = (classes.select("cid", "n", "vec").toDF(f"c{s}", f"n{s}", f"v{s}") for s in "ab")
    sized = star.join(a, F.col("a") == F.col("ca")).join(b, F.col("b") == F.col("cb"))
    near = sized.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", "na", "nb", "va", "vb")
    near = scratch.table(near.mapInArrow(_bounded(num, den), "a long, b long"), "near")
    roots = connected_components(near, scratch)
    member = tiles.select("key", "cid").union(tiles.select("key", "hub").distinct())
    marked = member.join(roots, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    marked = scratch.table(marked, "marked")
    scratch.drop("tiles")
    mixed = marked.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("m > 2 and lo <> hi").select(F.col("key").alias("tile"))
    open_rows = marked.join(mixed, F.col("key") == F.col("tile"), "left_semi").join(classes.select(F.col("cid").alias("c"), "n", "vec"), F.col("cid") == F.col("c")).select("key", "cid", "root", "n", "vec")
    units = _units(open_rows, "key", F.octet_length("vec"), scratch, "tile-units")
    units = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    edges = scratch.table(units.mapInArrow(_tile_edges(num, den), "a long, b long"), "edges")
    if not edges.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges), scratch)
    scratch.drop("marked")
    member = roots.join(classes.select("cid", "n", "place"), F.col("node") == F.col("cid")).select(F.col("root").alias("cluster"), "cid", "n", "place")
    member = scratch.table(member, "member")

    def linked(units: DataFrame, name: str) -> DataFrame:
        """Links within units of clusters, whose whole sets are fetched once for each unit."""
        want = scratch.table(units, f"{name}-want")
        rows = docs.select("d", "text").join(F.broadcast(want) if want.count() <= FETCH else want, F.col("d") == F.col("place"))
        names = ["text", "cluster", "lo", "hi", "side", "cid", "root"]
        block = "struct<of:long,i:int>"
        sets = rows.select(*names).mapInArrow(_sets(k, clashes, names), f"cluster long, lo {block}, hi {block}, side int, cid long, root long, shingles array<long>")
        return scratch.table(sets.groupBy("cluster", "lo", "hi").applyInArrow(_cluster_links(num, den), "a long, b long"), name)

    # clusters of more than LIMIT shingles: all blocks against the first, then what is still apart
    large = member.groupBy("cluster").agg(F.sum("n").alias("w")).where(F.col("w") > LIMIT).select(F.col("cluster").alias("g"), F.ceil(F.col("w") / (LIMIT // 2)).cast("int").alias("m"))
    large = scratch.table(large, "large")
    block = lambda i: F.struct(F.lit(0).cast("long").alias("of"), F.lit(i).cast("int").alias("i") if isinstance(i, int) else F.col(i).alias("i"))
    member = member.withColumn("root", F.col("cid"))
    plain = ["cluster", "cid", "root", "n", "place"]
    if large.isEmpty():
        links = linked(member.select(*plain, block(0).alias("lo"), block(0).alias("hi"), F.lit(1).alias("side")), "links")
        named = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        small = member.join(large, F.col("cluster") == F.col("g"), "left_anti").select(*plain, block(0).alias("lo"), block(0).alias("hi"), F.lit(1).alias("side"))
        big = member.join(large, F.col("cluster") == F.col("g")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("m")).cast("int"))
        each = big.select(*plain, block(0).alias("lo"), block("own").alias("hi"), F.lit(1).alias("side"))
        first = big.where("own = 0").withColumn("with", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select(*plain, block(0).alias("lo"), block("with").alias("hi"), F.lit(0).alias("side"))
        links = linked(small.unionByName(each).unionByName(first), "links")
        so_far = connected_components(links, scratch).withColumnRenamed("root", "found")
        apart = big.join(so_far, F.col("cid") == F.col("node"), "left").select("cluster", "cid", F.coalesce("found", "root").alias("root"), "n", "place")
        more = linked(_units(apart, "cluster", F.col("n"), scratch, "cluster-units"), "more")
        named = connected_components(links.union(more), scratch)
    component = classes.select("cid", "least").join(named, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    component = scratch.table(component, "component")
    least = scratch.table(component.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"), "least")
    known = scratch.table(component.join(least, F.col("root") == F.col("r")).select(F.col("cid").alias("c"), "component_id"), "known")
    out = base.select("doc_id", "n", "cid").join(known, F.col("cid") == F.col("c"), "left")
    out = scratch.table(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "result")
    scratch.only("result")
    return out
