"""SimHash near-dedup: 64-bit fingerprints, linked at RADIUS or fewer differing bits.

Fingerprints are searched by the generalised pigeonhole principle. Their bits are
dealt into m partitions, correlated bits together. If the thresholds t1..tm of a
fingerprint sum to RADIUS - m + 1, each fingerprint within RADIUS of it is within
ti of it in some partition i; -1 leaves a partition out. For every fingerprint a
small dynamic program picks the thresholds that cost least by the candidates and
probes that they are estimated to make. Candidates are estimated from counts of the
values that occur in pieces of at most PIECE bits, so what the driver and the tasks
hold for it is bounded by 2**PIECE counts a piece, whatever the corpus; values
of wider partitions are taken as two independent pieces. m itself (2, 3 or 4) is the
one whose estimated cost over all fingerprints is least: few fingerprints are found
best in four partitions, very many in two of 32 bits.

Every distinct fingerprint is filed under its value in each partition, and probes
the values within its thresholds. What meets under a value is verified exactly, in
one task, which gives links of a spanning forest alone, so that a large group of
near copies gives as many links as members. A value with more than LIMIT rows is
dealt on by the bits outside its partition: what is within RADIUS there agrees in
one of RADIUS + 1 pieces of them; and again, until the groups are small.

Words, shingles and hashes are as fingerprint() states. Documents without words
have fingerprint zero, linked like any other. Null text counts as empty. A row with
null doc_id gets the component of its fingerprint; the smallest doc_id that is not
null names it, and a component of such rows alone has none. Repeated rows share
their fingerprint. Very long texts are hashed whole, in blocks. An empty table gives
no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, Scratch, Words, lean, mix, text_chunks, tune
from .components import connected_components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Numbers of partitions that are weighed, and the bits of a piece whose values are counted.
PARTITIONS, PIECE = (2, 3, 4), 16
#: A row that is dealt out costs as much as so many candidates that are compared.
ROW_COST = 50
#: Rows that meet in one group at most; with more they are dealt on.
LIMIT = 4096
#: Groups of up to so many rows are compared many at once; spans hashed, and rows gathered, at once.
SMALL, BLOCK = 32, 1 << 15


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' lower-case words with one space after each: bytes, starts and ends of words, and each row's first word."""
    w = Words(data, off, NONSPACE, seeds=())
    size = w.end - w.start
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    # a byte's place is its place among all bytes of words, and one more for each word before
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.low[NONSPACE[w.low]]
    return out, start, start + size, w.bounds


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A fingerprint (int64) for each row: a bit is set if over half the hashes of its shingles, repeats included, have it.

    A-Z are lower-cased and words are runs of bytes other than ASCII white space.
    Shingles are SHINGLE words with spaces between; fewer words are one shingle, no
    word gives zero. Hashes are XXH64 with SEED.
    """
    text, start, end, bounds = spaced(data, off)
    raw, rows = memoryview(text), len(off) - 1
    words = np.diff(bounds)
    shingles = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(rows), shingles)
    first = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + bounds[:-1][row]
    last = np.minimum(first + SHINGLE, bounds[1:][row]) - 1
    ones = np.zeros((rows, BITS), np.int64)
    for at in range(0, len(row), BLOCK):
        part = slice(at, at + BLOCK)
        spans = zip(start[first[part]].tolist(), end[last[part]].tolist(), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(raw[a:z], SEED) for a, z in spans), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = row[part]
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ones[owner[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    out = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
    return out.view("<i8")[:, 0] if rows else np.zeros(0, np.int64)


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, data, off in text_chunks(b.column(1)):
            fp = fingerprints(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(fp)), pa.array(fp)], names=["doc_id", "fp"])


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(bits: np.ndarray) -> np.int64:
    """The fingerprint that has the named bits set."""
    return np.packbits(np.isin(np.arange(BITS), bits), bitorder="little").view("<i8")[0]


def _together(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """Columns of several batches at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(held[0].num_columns)]
            held, n = [], 0
    if n:
        yield [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(held[0].num_columns)]


def _both_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many fingerprints have each pair of bits set, and in cell -1 how many there are."""
    total, n = np.zeros((BITS, BITS), np.int64), 0
    for (fp,) in _together(batches):
        b = _bits(fp).astype(np.float64)
        total += (b.T @ b).astype(np.int64)
        n += len(fp)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.concatenate([[n], total.ravel()]))], names=["cell", "c"])


def correlation(both: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlation of bits, 0 with bits that never change."""
    p = np.diag(both) / n
    sd = np.sqrt(p * (1 - p))
    out = np.abs(both / n - np.outer(p, p)) / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), np.inf)
    np.fill_diagonal(out, 0)
    return out


def grouped(corr: np.ndarray, m: int) -> list[np.ndarray]:
    """Bits of m partitions: each starts from the bit that is bound most to those left, and takes what is bound most to it."""
    left, out = list(range(len(corr))), []
    for i in range(m):
        size = len(left) // (m - i)
        group = [left.pop(int(corr[np.ix_(left, left)].sum(1).argmax()))]
        while len(group) < size:
            group.append(left.pop(int(corr[np.ix_(left, group)].sum(1).argmax())))
        out.append(np.array(sorted(group)))
    return out


def pieces(bits: np.ndarray) -> list[np.ndarray]:
    return np.array_split(bits, -(-len(bits) // PIECE))


def value(unpacked: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The number that the named bits make, the first the least."""
    return unpacked[:, bits].astype(np.int64) @ (1 << np.arange(len(bits), dtype=np.int64))


def at_distance(counts: np.ndarray) -> np.ndarray:
    """For every value of a piece, how many fingerprints have a value 0, 1, .. RADIUS bits away."""
    out = np.zeros((RADIUS + 1, len(counts)))
    out[0] = counts
    every = np.arange(len(counts))
    for bit in range(len(counts).bit_length() - 1):
        out[1:] += out[:-1, every ^ (1 << bit)]
    return out


class Search:
    """Partitions of one m, counts of their pieces, and what follows from them for a fingerprint."""

    def __init__(self, bits: list[np.ndarray], counts: list[list[np.ndarray]], n: int) -> None:
        self.bits, self.n = bits, max(n, 1)
        self.near = [[at_distance(c) for c in of] for of in counts]

    def candidates(self, unpacked: np.ndarray, i: int) -> np.ndarray:
        """Estimated fingerprints within 0, 1, .. RADIUS bits of each one in partition i."""
        out = None
        for bits, near in zip(pieces(self.bits[i]), self.near[i], strict=True):
            here = near[:, value(unpacked, bits)]
            out = here if out is None else np.array([sum(out[a] * here[d - a] for a in range(d + 1)) for d in range(RADIUS + 1)]) / self.n
        return np.cumsum(out, axis=0)

    def thresholds(self, unpacked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, thresholds by partition) of each fingerprint: the least cost whose thresholds sum to RADIUS - m + 1."""
        m, rows = len(self.bits), len(unpacked)
        best = {0: (np.zeros(rows), np.zeros((0, rows), np.int8))}
        for i in range(m):
            near = self.candidates(unpacked, i)
            after: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for total, (cost, chosen) in best.items():
                for t in range(-1, RADIUS + 1):
                    probes = sum(comb(len(self.bits[i]), d) for d in range(1, t + 1))
                    more = cost + (near[t] if t >= 0 else 0) + ROW_COST * (1 + probes)
                    path = np.vstack([chosen, np.full(rows, t, np.int8)])
                    if (old := after.get(total + t)) is not None:
                        less = more < old[0]
                        more, path = np.where(less, more, old[0]), np.where(less, path, old[1])
                    after[total + t] = (more, path)
            best = after
        cost, chosen = best[RADIUS - m + 1]
        return cost, chosen.T


def _count_values(plans: dict[int, list[np.ndarray]]):
    """(piece, value, c) over all pieces of all partitions of all plans; pieces are numbered in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [p for bits in plans.values() for part in bits for p in pieces(part)]
        counts = [np.zeros(1 << len(p), np.int64) for p in every]
        for (fp,) in _together(batches):
            unpacked = _bits(fp)
            for c, p in zip(counts, every, strict=True):
                c += np.bincount(value(unpacked, p), minlength=len(c))
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(c[at])], names=["piece", "value", "c"])

    return run


def _searches(plans: dict[int, list[np.ndarray]], held: tuple[np.ndarray, ...], n: int) -> dict[int, Search]:
    piece, at, c = held
    out, i = {}, 0
    for m, bits in plans.items():
        counts = []
        for part in bits:
            counts.append([])
            for p in pieces(part):
                table = np.zeros(1 << len(p), np.int64)
                mine = piece == i
                table[at[mine]] = c[mine]
                counts[-1].append(table)
                i += 1
        out[m] = Search(bits, counts, n)
    return out


#: Roles of a row under a value: filed there, probing there.
FILED, PROBES = 1, 2


def _file(search: Search):
    """Rows (key, fp, role, free): each fingerprint under its values, and under those that it probes; free has the bits outside the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = search()
        outside = [packed(np.setdiff1d(np.arange(BITS), bits)) for bits in made.bits]
        for (fp,) in _together(batches, BLOCK // 4):
            unpacked = _bits(fp)
            _, chosen = made.thresholds(unpacked)
            for i, bits in enumerate(made.bits):
                v, t = value(unpacked, bits) | np.int64(i << 40), chosen[:, i]
                parts = [(v, fp, np.where(t >= 0, FILED | PROBES, FILED))]
                for d in range(1, RADIUS + 1):
                    goes = np.flatnonzero(t >= d)
                    if len(goes):
                        for flip in combinations(range(len(bits)), d):
                            parts.append((v[goes] ^ np.int64(sum(1 << b for b in flip)), fp[goes], np.full(len(goes), PROBES)))
                key, f, role = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f), pa.array(role.astype(np.int32)), pa.array(np.full(len(key), outside[i]))], names=["key", "fp", "role", "free"])

    return run


#: Groups whose free bits are fewer are not dealt on; they hold at most 2**7 fingerprints of each probed value.
LEAST_FREE = 8


def _deal_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large groups, under each of RADIUS + 1 pieces of their free bits."""
    for key, fp, role, free in _together(batches, BLOCK // 4):
        for f in np.unique(free):
            mine = free == f
            set_bits = np.flatnonzero(_bits(np.array([f]))[0])
            for i in range(RADIUS + 1):
                piece = packed(set_bits[i::RADIUS + 1])
                with np.errstate(over="ignore"):
                    h = mix(mix(key[mine].view(np.uint64) + np.uint64(i + 1)) ^ (fp[mine] & piece).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(fp[mine]), pa.array(role[mine]), pa.array(np.full(mine.sum(), f & ~piece))], names=["key", "fp", "role", "free"])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make label, each row's least known companion, the same for rows a and b."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _forest(key: np.ndarray, fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that join what is linked within each group of rows of equal key; rows are sorted by key."""
    label = np.arange(len(key))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    # many small groups: each row with the one d places on
    small = np.repeat(size <= SMALL, size)
    left = np.repeat(first + size, size) - np.arange(len(key))
    at = np.flatnonzero(small & (left > 1))
    for d in range(1, SMALL):
        at = at[left[at] > d]
        if not len(at):
            break
        other = at + d
        meets = ((role[at] & role[other] >> 1) | (role[at] >> 1 & role[other])) & 1 > 0
        near = meets & (np.bitwise_count((fp[at] ^ fp[other]).view(np.uint64)) <= RADIUS)
        _merge(label, at[near], other[near])
    for a, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
        rows = np.arange(a, a + n)
        filed, probes = rows[role[a:a + n] & FILED > 0], rows[role[a:a + n] & PROBES > 0]
        step, local = max(1, (1 << 20) // max(len(filed), 1)), np.arange(n)
        for x in range(0, len(probes), step):
            p = probes[x:x + step]
            i, j = np.nonzero(np.bitwise_count((fp[p][:, None] ^ fp[filed][None, :]).view(np.uint64)) <= RADIUS)
            _merge(local, p[i] - a, filed[j] - a)
        label[a:a + n] = local + a
    moved = label != np.arange(len(key))
    return fp[moved], fp[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole groups, of rows sorted by key."""
    held: list[np.ndarray] | None = None
    for cols in _together(batches):
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
        held = [c[whole:] for c in cols]
        if whole:
            a, b = _forest(*(c[:whole] for c in cols))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    if held is not None:
        a, b = _forest(*held)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def linked_fingerprints(prints: DataFrame, scratch: Scratch, limit: int = LIMIT, partitions: tuple[int, ...] = PARTITIONS) -> DataFrame:
    """Links (a, b) that join all fingerprints within RADIUS of each other; prints is a stored table of distinct longs fp."""
    spark, fp = prints.sparkSession, prints.select("fp")
    cells = {r.cell: r.c for r in fp.mapInArrow(_both_set, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect()}
    n = cells.pop(-1, 0)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    corr = correlation(np.array([cells[i] for i in range(BITS * BITS)], float).reshape(BITS, BITS), n)
    plans = {m: grouped(corr, m) for m in partitions}
    counts = fp.mapInArrow(_count_values(plans), "piece int, value long, c long").groupBy("piece", "value").agg(F.sum("c").alias("c")).toArrow()
    shared = spark.sparkContext.broadcast(tuple(counts.column(c).to_numpy() for c in ("piece", "value", "c")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _searches(plans, shared.value, n)
        total = dict.fromkeys(made, 0.0)
        for (x,) in _together(batches, BLOCK // 4):
            for m, search in made.items():
                total[m] += float(search.thresholds(_bits(x))[0].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()))], names=["m", "cost"])

    costs = {r.m: r.cost for r in fp.mapInArrow(weigh, "m int, cost double").groupBy("m").agg(F.sum("cost").alias("cost")).collect()} if len(plans) > 1 else dict.fromkeys(plans, 0.0)
    best = min(costs, key=lambda m: (costs[m], m))
    rows = scratch.table(fp.mapInArrow(_file(lambda: _searches(plans, shared.value, n)[best]), "key long, fp long, role int, free long"), "filed-0")

    groups = []
    for level in range(1, BITS):
        hot = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select(F.col("key").alias("k"))
        hot = scratch.table(hot, f"hot-{level}")
        dealt = F.bit_count("free") >= LEAST_FREE
        large = rows.where(dealt).join(hot, F.col("key") == F.col("k"), "left_semi")
        if hot.isEmpty() or large.isEmpty():
            groups.append(rows)
            break
        groups.append(rows.where(~dealt).unionByName(rows.where(dealt).join(hot, F.col("key") == F.col("k"), "left_anti")))
        rows = scratch.table(large.mapInArrow(_deal_on, rows.schema), f"filed-{level}")
    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    met = every.select("key", "fp", "role").repartition("key").sortWithinPartitions("key")
    return scratch.table(met.mapInArrow(_links, "a long, b long").distinct(), "links")


def simhash_components(docs: DataFrame, limit: int = LIMIT, partitions: tuple[int, ...] = PARTITIONS) -> DataFrame:
    """doc_id, fp (long) and component_id of every document."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = scratch.table(docs.mapInArrow(_scan, "doc_id long, fp long"), "base")
    prints = scratch.table(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(linked_fingerprints(prints, scratch, limit, partitions), scratch)
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.table(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    known = scratch.table(named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "known")
    out = scratch.table(base.join(known, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id"), "result")
    scratch.only("result")
    return out


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
