"""Suffix-array dedup: removal of repeated strings of SIZE bytes.

A suffix array of every byte would take many times the input, so the arrays here
are sparse: of each SIZE-byte window only the suffix at its least GRAM-byte hash
is indexed, any of them on ties, which random numbers break, so that periodic text
gives no more suffixes than other text. Equal windows have the same least gram, so
any repeated window is found from a shared suffix. An array is dealt into parts by
hash; each part holds the suffixes' first GRAM bytes in lexical order, each with
the length of the prefix that it shares with the one before (LCP).

Logarithmic index family. Texts come in batches. A new batch gets a sorted array,
which a merge scan runs into the levels of equal size, as in a binary counter:
neighbours whose LCP is GRAM are the same suffix and become one row. A level that
is not merged with is scanned for the batch's suffixes by their hashes. Levels are
tables in a shared folder. Suffixes of one task are combined before they are
dealt out, so common passages do not gather in a task.

Long matches. Around the suffixes that occur more than once, the windows that
they stand for are compared within groups of at most about GROUP occurrences.
Suffixes that occur more often (a line on many pages) are told apart further: a
window either holds SIDE bytes before its suffix or SIDE bytes after it, and joins
the windows that hold the same ones; only windows that hold their least gram twice,
which equal windows may hold at another place, stay together. What is then still
more than a group is dealt into several: a window repeated in its part counts at
once, the others are compared across parts by hash. Windows of one suffix all hold
it, so the bytes they cover are one span.

Texts with copies are compared once; of SIZE bytes or more they go whole. Texts
stay where they are while repeated suffixes, copied texts and spans are few enough
to be broadcast (FEW); beyond that they are joined by a shuffle.

Null text counts as empty. Null doc_id is kept. Repeated rows are copies of each
other. Extra columns are ignored. Very long texts are indexed piece by piece. An
empty table gives no row. Texts are told apart by 128 bits, windows and suffixes
by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, lean, mix, span_hash, text_chunks, tune

SIZE, GRAM = 400, 64
BATCHES = 4
GROUP = 2048
#: Bytes on one side of a suffix that tell its occurrences apart; each window holds them on the left or on the right.
SIDE = (SIZE - GRAM) // 2
#: Rows of complete groups that are compared in one numpy pass.
ROWS = 2048
#: Rows of a table that may be broadcast.
FEW = 500_000
_REACH = SIZE - GRAM + 1
#: Bits of a place within a piece of text, an even number, and odd numbers that deal places at random, with their inverses.
_BITS = (int(CHUNK_BYTES + SIZE).bit_length() + 1) // 2 * 2
_MASK = np.uint64((1 << _BITS) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B1, 0x85EBCA77)]
_BACK = [np.uint64(pow(int(x), -1, 1 << _BITS)) for x in _ODD]


def _deal(x: np.ndarray, odd: list[np.uint64]) -> np.ndarray:
    """A permutation of places; with _BACK reversed, its inverse."""
    x = x * odd[0] & _MASK
    x ^= x >> np.uint64(_BITS // 2)
    return x * odd[1] & _MASK


def _sliding_min(v: np.ndarray, count: int) -> np.ndarray:
    """Least of each _REACH values in a row, from running minima of blocks in both directions."""
    full = np.concatenate([v, np.full(-len(v) % _REACH, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, _REACH)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[_REACH - 1:_REACH - 1 + count])


def _least_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a least gram of each window, hashes of all grams) of at most a piece of text."""
    at, count = np.arange(len(data) - GRAM + 1), len(data) - SIZE + 1
    h = span_hash(data, at, at + GRAM)
    dealt = (h & ~_MASK) | _deal(at.astype(np.uint64), _ODD)
    place = _deal(_sliding_min(dealt, count) & _MASK, _BACK[::-1]).astype(np.int64)
    least = _sliding_min(h, count)
    for s in np.flatnonzero(h[place] != least):  # unequal grams that agree in all but the last bits
        place[s] = s + np.flatnonzero(h[s:s + _REACH] == least[s])[0]
    return place, h


def sampled(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, suffix, first window, last window, key) of all indexed suffixes; places are within the chunk."""
    parts = []
    for a in range(0, max(len(data) - SIZE + 1, 0), CHUNK_BYTES):
        piece = data[a:a + CHUNK_BYTES + SIZE - 1]
        place, h = _least_grams(piece)
        s = np.arange(a, a + len(place))
        text = np.searchsorted(off, s, "right") - 1
        inside = np.flatnonzero(s + SIZE <= off[text + 1])
        s, p, text = s[inside], place[inside], text[inside]
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s))[: len(first)] - 1
        parts.append((text[first], p[first] + a, s[first], s[last], h[p[first]]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_ARRAY = "suffix binary, key long, n long, a long, z long"


def _array_rows(suffix: np.ndarray, key, n, a, z, lcp=None) -> pa.RecordBatch:
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GRAM), len(suffix), [None, pa.py_buffer(np.ascontiguousarray(suffix).tobytes())]).cast(pa.binary())
    cols, names = [flat, *(pa.array(x, pa.int64()) for x in (key, n, a, z))], ["suffix", "key", "n", "a", "z"]
    if lcp is not None:
        cols, names = [*cols, pa.array(lcp, pa.int32())], [*names, "lcp"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def _runs(same: np.ndarray) -> np.ndarray:
    """Starts of runs; same[i] tells whether row i + 1 goes on with row i."""
    return np.flatnonzero(np.concatenate([[True], ~same]))


def _again(raw: bytes, p: int, lo: int, hi: int) -> bool:
    """Whether the windows from lo to hi hold their suffix's first bytes at another place, too, so that they may repeat among themselves."""
    gram = raw[p:p + GRAM]
    return raw.find(gram, p + 1, hi + SIZE) >= 0 or raw.rfind(gram, lo, p + GRAM - 1) >= 0


@lean
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the array of each batch of texts: a suffix, its hash, its occurrences, and the least and largest hash of a place."""
    for b in batches:
        th = np.asarray(b.column(0)).view(np.uint64)
        for first, data, off in text_chunks(b.column(1)):
            text, p, lo, hi, key = sampled(data, off)
            if not len(p):
                continue
            with np.errstate(over="ignore"):
                place = mix(th[first + text] + mix((p - off[:-1][text]).astype(np.uint64))).view(np.int64)
            raw = data.tobytes()
            again = np.fromiter((_again(raw, *x) for x in zip(p.tolist(), lo.tolist(), hi.tolist(), strict=True)), bool, len(p))
            order = np.argsort(key, kind="stable")
            key, place, p, other = key[order].view(np.int64), place[order], p[order], (place ^ again)[order]
            start = _runs(key[1:] == key[:-1])
            suffix = data[p[start][:, None] + np.arange(GRAM)]
            n = np.diff(np.append(start, len(p)))
            yield _array_rows(suffix, key[start], n, np.minimum.reduceat(np.minimum(place, other), start), np.maximum.reduceat(np.maximum(place, other), start))


@lean
def _merge_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of several arrays -> one array: neighbours are compared byte by byte, and those of LCP GRAM become one row."""
    held: pa.Table | None = None
    before = 0  # LCP of the held row

    def run(table: pa.Table) -> pa.RecordBatch:
        key, n, a, z = (np.asarray(table.column(c)) for c in ("key", "n", "a", "z"))
        x = np.frombuffer(b"".join(table.column("suffix").to_pylist()), np.uint8).reshape(-1, GRAM)
        equal = x[1:] == x[:-1]
        same = equal.all(1)
        lcp = np.concatenate([[before], np.where(same, GRAM, equal.argmin(1))])
        start = _runs(same)
        return _array_rows(x[start], key[start], np.add.reduceat(n, start), np.minimum.reduceat(a, start), np.maximum.reduceat(z, start), lcp[start])

    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        merged = pa.Table.from_batches([run(table)])
        whole = merged.slice(0, merged.num_rows - 1)  # the last suffix may go on
        if whole.num_rows:
            yield from whole.combine_chunks().to_batches()
        before = merged.column("lcp")[-1].as_py()
        held = merged.slice(merged.num_rows - 1).drop_columns(["lcp"])
    if held is not None and held.num_rows:
        yield run(held)


class IndexFamily:
    """Levels of sorted suffix tables; level i holds 2**i batches or nothing."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch = scratch
        self.levels: dict[int, tuple[str, DataFrame]] = {}
        self.shared: list[DataFrame] = []
        self.made = 0

    def _array(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = f"level{self.made}"
        self.made += 1
        rows = rows.repartition("key").sortWithinPartitions("suffix")
        return name, self.scratch.table(rows.mapInArrow(_merge_scan, f"{_ARRAY}, lcp int"), name)

    def add(self, batch: DataFrame) -> None:
        """Index the rows of a new batch's array, merge levels of equal size, and note the suffixes that it shares with the others."""
        rows, i, old = batch, 0, []
        while i in self.levels:
            name, level = self.levels.pop(i)
            rows, i = rows.unionByName(level.drop("lcp")), i + 1
            old.append(name)
        name, array = self._array(rows)
        self.scratch.drop(*old)
        for above, level in self.levels.values():
            both = array.select("key", "n").join(level.select(F.col("key").alias("k"), F.col("n").alias("m")), F.col("key") == F.col("k"))
            self.shared.append(self.scratch.table(both.select("key", (F.col("n") + F.col("m")).alias("n")), f"{name}-{above}"))
        self.levels[i] = name, array

    def repeated(self) -> DataFrame:
        """(key, n) of all suffixes met in more than one place; n is at least half of the occurrences in any two levels."""
        found = [level.where("a <> z").select("key", "n") for _, level in self.levels.values()] + self.shared
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.groupBy("key").agg(F.sum("n").alias("n"))


_CONTEXT = "key long, th long, pos long, lo long, n long, bytes binary"


@lean
def _all_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _CONTEXT around all indexed suffixes: the windows that each stands for."""
    for b in batches:
        th = np.asarray(b.column(0))
        for first, data, off in text_chunks(b.column(1)):
            text, p, lo, hi, key = sampled(data, off)
            raw = data.tobytes()
            for i in range(0, len(p), 4096):
                t, x, z = text[i:i + 4096], lo[i:i + 4096], hi[i:i + 4096]
                base = off[:-1][t]
                bytes_ = pa.array([raw[u:v + SIZE] for u, v in zip(x.tolist(), z.tolist(), strict=True)], pa.binary())
                cols = [key[i:i + 4096].view(np.int64), th[first + t], p[i:i + 4096] - base, x - base, z - x + 1]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), bytes_], names=["key", "th", "pos", "lo", "n", "bytes"])


@lean
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (th, pos, lo, n, key) of all indexed suffixes."""
    for b in batches:
        th = np.asarray(b.column(0))
        for first, data, off in text_chunks(b.column(1)):
            text, p, lo, hi, key = sampled(data, off)
            base = off[:-1][text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (th[first + text], p - base, lo - base, hi - lo + 1, key.view(np.int64))], names=["th", "pos", "lo", "n", "key"])


@lean
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _CONTEXT around given places of each text."""
    for b in batches:
        for th, text, places in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            raw = text.encode()
            for i in range(0, len(places), 4096):
                rows = [(p["key"], th, p["pos"], p["lo"], p["n"], raw[p["lo"]:p["lo"] + p["n"] + SIZE - 1]) for p in places[i:i + 4096]]
                types = [*[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "th", "pos", "lo", "n", "bytes"])


_AROUND = "key long, whole boolean, often boolean, th long, pos long, lo long, n long, bytes binary"


@lean
def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _CONTEXT with `often`; those of frequent suffixes are cut by what their windows hold beside the suffix, `whole` where windows hold their gram twice."""
    names = ["key", "whole", "often", "th", "pos", "lo", "n", "bytes"]
    for b in batches:
        often = b.column(6)
        plain = b.filter(pc.invert(often))
        if plain.num_rows:
            no = pa.array(np.zeros(plain.num_rows, bool))
            yield pa.RecordBatch.from_arrays([plain.column(0), no, no, *plain.columns[1:6]], names=names)
        rows = []
        for key, th, pos, lo, n, raw in zip(*(c.to_pylist() for c in b.filter(often).columns[:6]), strict=True):
            p = pos - lo
            gram = raw[p:p + GRAM]
            before, after = raw.rfind(gram, 0, p + GRAM - 1), raw.find(gram, p + 1)
            first, stop = before + 1, n if after < 0 else min(n, max(after - (SIZE - GRAM), 0))
            middle = min(max(p - SIDE + 1, first), max(stop, first))
            name = key.to_bytes(8, "little", signed=True)
            for x, z, side in ((0, min(first, n), None), (first, min(middle, stop), raw[max(p - SIDE, 0):p] + b"<"), (middle, stop, b">" + raw[p + GRAM:p + GRAM + SIDE]), (max(stop, first), n, None)):
                if x < z:
                    to = key if side is None else int.from_bytes(hashlib.blake2b(name + side, digest_size=8).digest(), "little", signed=True)
                    rows.append((to, side is None, True, th, pos, lo + x, z - x, raw[x:z - 1 + SIZE]))
        if rows:
            types = [pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


@lean
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (th, spans): overlapping spans of a text made one."""
    for b in batches:
        out = []
        for spans in b.column(1).to_pylist():
            runs: list[dict] = []
            for a, z in sorted((s["a"], s["z"]) for s in spans):
                if runs and a <= runs[-1]["z"]:
                    runs[-1]["z"] = max(runs[-1]["z"], z)
                else:
                    runs.append({"a": a, "z": z})
            out.append(runs)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))], names=["th", "spans"])


def _compare(key, parts, th, lo, n, data: bytes, sizes) -> Iterator[pa.RecordBatch]:
    """Spans of complete groups, and for groups in parts the windows still open."""
    buf = np.frombuffer(data, np.uint8)
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = base[row] + nth
    h = span_hash(buf, start, start + SIZE)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    dup = np.zeros(len(h), bool)
    dup[order[1:][same]] = True
    dup[order[:-1][same]] = True
    hit = np.flatnonzero(dup)
    if len(hit):
        r = row[hit]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        last = np.append(first[1:], len(r)) - 1
        rows = r[first]
        yield _found(np.zeros(len(rows)), th[rows], lo[rows] + nth[hit[first]], lo[rows] + nth[hit[last]] + SIZE, np.zeros(len(rows)))
    many = parts > 1
    if many.any():
        rest = np.flatnonzero(many[row] & ~dup)
        done = np.unique(h[np.flatnonzero(many[row] & dup)])
        r = row[rest]
        yield _found(np.ones(len(rest)), th[r], lo[r] + nth[rest], lo[r] + nth[rest] + SIZE, h[rest].view(np.int64))
        zero = np.zeros(len(done))
        yield _found(zero + 2, zero, zero, zero, done.view(np.int64))


def _found(kind, th, a, z, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (th, a, z, h))], names=["kind", "th", "a", "z", "h"])


@lean
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare groups of rows sorted by (key, part), many groups at a time."""
    held: list[pa.RecordBatch] = []

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = table.column("bytes").combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
        raw = col.to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        key, parts, th, lo, n = (np.asarray(table.column(c)) for c in ("key", "parts", "th", "lo", "n"))
        yield from _compare(key, parts, th, lo, n, b"".join(raw), sizes)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < ROWS:
            continue
        table = pa.Table.from_batches(held)
        key, part = np.asarray(table.column("key")), np.asarray(table.column("part"))
        ends = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
        if len(ends):
            cut = int(ends[-1]) + 1
            yield from run(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield from run(pa.Table.from_batches(held))


@lean
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, copies, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw = (text or "").encode()
            if len(raw) >= SIZE and (copies or 1) > 1:
                rows.append((doc_id, len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest(), ""))
                continue
            kept, at, runs = [], 0, []
            for s in sorted((x["a"], x["z"]) for x in spans or []):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            for a, z in runs:
                kept.append(raw[at:a])
                at = z
            left = b"".join([*kept, raw[at:]])
            rows.append((doc_id, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), ",".join(f"{a}-{z}" for a, z in runs)))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def substring_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs as a-b,...) of every document."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    texts = docs.groupBy(one.alias("th"), two.alias("t2")).agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("place"))
    texts = scratch.table(texts, "texts")
    clashes = [r.th for r in texts.groupBy("th").count().where("count > 1").collect()]  # about n * n / 2**65 of n texts
    named = lambda th, t2: F.when(th.isin(clashes), F.xxhash64(th, t2)).otherwise(th) if clashes else th
    docs = docs.withColumn("th", named(one, two))
    few = lambda df: df.limit(FEW + 1).count() <= FEW
    copied = texts.where("copies > 1").select(named(F.col("th"), F.col("t2")).alias("ct"), "copies", "place")
    copied_few = few(copied)
    # the first of each text's copies, for a shuffle or not
    single = docs.join(F.broadcast(copied) if copied_few else copied, F.col("th") == F.col("ct"), "left")
    single = single.where("ct is null or place = coalesce(doc_id, -1)").select("th", "text")

    family = IndexFamily(scratch)
    for i in range(batches):
        batch = single.where(F.pmod(F.xxhash64(F.lit(3), "th"), F.lit(batches)) == i)
        family.add(batch.mapInArrow(_index, _ARRAY))
    repeated = scratch.table(family.repeated().select(F.col("key").alias("k"), F.ceil(F.col("n") / GROUP).cast("int").alias("parts")), "repeated")
    scratch.only("texts", "repeated")

    if few(repeated):
        around = single.mapInArrow(_all_contexts, _CONTEXT).join(F.broadcast(repeated), F.col("key") == F.col("k"))
    else:
        met = single.mapInArrow(_places, "th long, pos long, lo long, n long, key long").join(repeated, F.col("key") == F.col("k"))
        met = scratch.table(met.select("th", F.struct("pos", "lo", "n", "key").alias("p")), "met")
        places = met.groupBy(F.col("th").alias("pt")).agg(F.collect_set("p").alias("places"))
        around = single.join(places, F.col("th") == F.col("pt")).select("th", "text", "places").mapInArrow(_contexts, _CONTEXT).join(repeated, F.col("key") == F.col("k"))
    around = around.select("key", "th", "pos", "lo", "n", "bytes", (F.col("parts") > 1).alias("often")).mapInArrow(_apart, _AROUND)
    around = scratch.table(around, "around")
    still = around.where("often").groupBy(F.col("key").alias("k2"), F.col("whole").alias("w2")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("parts > 1")
    still = scratch.table(still, "still")
    around = around.join(F.broadcast(still) if few(still) else still, F.col("often") & (F.col("key") == F.col("k2")) & (F.col("whole") == F.col("w2")), "left")
    parts = F.coalesce("parts", F.lit(1))
    around = around.select("key", F.pmod(F.xxhash64("th", "pos"), parts).cast("int").alias("part"), parts.alias("parts"), "th", "lo", "n", "bytes")
    around = around.repartition("key", "part").sortWithinPartitions("key", "part")
    found = scratch.table(around.mapInArrow(_groups, "kind int, th long, a long, z long, h long"), "found")
    scratch.drop("around")

    apart = found.where("kind > 0").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("hh"))
    across = found.where("kind = 1").join(apart, F.col("h") == F.col("hh")).select("th", "a", "z")
    spans = found.where("kind = 0").select("th", "a", "z").union(across)
    spans = spans.groupBy("th").agg(F.collect_set(F.struct("a", "z")).alias("spans")).mapInArrow(_merged, "th long, spans array<struct<a:long,z:long>>")
    known = spans.join(copied, F.col("th") == F.col("ct"), "full").select(F.coalesce("th", "ct").alias("t"), "copies", F.when(F.col("copies").isNull(), F.col("spans")).alias("spans"))
    known = scratch.table(known, "known")
    small = few(known) and known.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first().n <= FEW
    out = docs.join(F.broadcast(known) if small else known, F.col("th") == F.col("t"), "left").select("doc_id", "text", "copies", "spans")
    out = scratch.table(out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"), "result")
    scratch.only("result")
    return out
