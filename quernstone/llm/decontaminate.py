"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII
characters; five words make a shingle, weighted by the bytes of its words. For
each item, windows as long as the item slide over every document by one word (a
shorter document is one window). A document is contaminated by an item if the
weighted Jaccard similarity of their shingles, counted with repeats, is at least
THRESHOLD in some window.

A window reaches that only if shingles of items of its length hold THRESHOLD of
the least such item's weight; windows that do not are left out, which loses nothing. The others
get a 128-bit SimHash, cut into BLOCKS pieces. Of two fingerprints within RADIUS,
some piece differs in at most NEAR bits, so each item is filed under all values
within NEAR bits of each of its pieces, and a join on (length, piece, value) finds
all pairs within the radius; about a third of unlike pairs meet, and hardly any of
them is within the radius. Exact similarity verifies the rest. A pair at the
threshold is about 19 of 128 bits apart; a random fingerprint of it goes beyond
RADIUS about once in 20,000 times for one window.

Items are broadcast in blocks of ITEM_BLOCK, however many there are.
Items without words match nothing; items of fewer than five words are one
shingle. Null or empty text: not contaminated. Null item_id: reported as null.
Repeated rows of documents are reported once each; repeated items once each id.
Very long texts are one chunk each. Without documents or items there is no row.
Extra columns are ignored, and kept by clean().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Scratch, Words, lean, mix, numbered, text_chunks, tune, without_ids

K = 5
THRESHOLD = 0.8
#: Bits of a fingerprint's halves apart at most, pieces of a fingerprint, and bits of a piece apart at most: RADIUS < BLOCKS * (NEAR + 1).
RADIUS, BLOCKS, NEAR = 35, 12, 2
#: Items whose shingles are broadcast at once.
ITEM_BLOCK = 20_000

#: Rows of the index of items that may be broadcast.
INDEX_ROWS = 1_000_000
#: First and last bit of each piece of a half.
_BOUNDS = np.linspace(0, 64, BLOCKS // 2 + 1).astype(int)
_HALVES = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))


def fingerprints(h: np.ndarray, weight: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """SimHash of the shingles start to stop of each window, as two halves of 64 bits."""
    out = np.empty((len(start), 2), np.uint64)
    for half, salt in enumerate(_HALVES):
        mixed = mix(h ^ salt) if salt else h
        bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        total = np.zeros((len(h) + 1, 64), np.int64)
        np.cumsum((2 * bits - 1) * weight[:, None], axis=0, out=total[1:])
        out[:, half] = np.packbits(total[stop] > total[start], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def near_values(width: int) -> list[int]:
    """All numbers of so many bits with at most NEAR of them set."""
    return [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(width), n)]


def _pieces(low: Column, high: Column) -> Column:
    """The pieces of fingerprints given as two longs."""
    return F.array(*[F.shiftrightunsigned(half, int(a)).bitwiseAND(F.lit((1 << int(b - a)) - 1)).cast("int") for half in (low, high) for a, b in zip(_BOUNDS[:-1], _BOUNDS[1:], strict=True)])


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    weight = dict(zip(a.tolist(), wa.tolist(), strict=True)) | dict(zip(b.tolist(), wb.tolist(), strict=True))
    least = sum(min(n, cb[s]) * weight[s] for s, n in ca.items() if s in cb)
    total = sum(max(ca[s], cb[s]) * weight[s] for s in weight)
    return least / total if total else 0.0


def _weights(w: Words, at: np.ndarray, k: int) -> np.ndarray:
    size = np.concatenate([[0], np.cumsum(w.end - w.start)])
    return size[at + k] - size[at]


def _items(rows: list) -> list[tuple]:
    """(item_id, words, shingle hashes, weights) of items that have words."""
    out = []
    for item, text in rows:
        for _, data, off in text_chunks(pa.array([text], pa.large_string())):
            w = Words(data, off, ALNUM)
            n = len(w.start)
            if n:
                at, h = w.grams(min(K, n))
                out.append((item, n, h, _weights(w, at, min(K, n))))
    return out


_WINDOW = "_row long, doc_id long, first long, size int, low long, high long, grams binary, weights binary"


def _windows(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        known, lengths = {}, sorted({n for _, n, _, _ in items})
        bit = {n: np.uint64(1) << np.uint64(i % 64) for i, n in enumerate(lengths)}
        for k in {min(n, K) for n in lengths}:
            own = [(h, np.full(len(h), bit[n])) for _, n, h, _ in items if min(n, K) == k]
            h, of = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
            masks = np.zeros(len(h), np.uint64)
            np.bitwise_or.at(masks, of, np.concatenate([m for _, m in own]))
            known[k] = h, masks
        least: dict[int, int] = {}
        for _, n, _, wt in items:
            least[n] = min(least.get(n, 1 << 60), int(wt.sum()))
        filters = {}
        for k, (h, _) in known.items():
            filters[k] = np.zeros(1 << 22, bool)
            filters[k][h >> np.uint64(42)] = True
        for b in batches:
            rows = []
            rid, ids = np.asarray(b.column(0)), b.column(1)
            for first, data, off in text_chunks(b.column(2)):
                w = Words(data, off, ALNUM)
                for k, (set_, masks) in known.items():
                    at, h = w.grams(k)
                    maybe = np.flatnonzero(filters[k][h >> np.uint64(42)])
                    hits = maybe[np.isin(h[maybe], set_)]
                    if not len(hits):
                        continue
                    weight = _weights(w, at, k)
                    mask = np.zeros(len(h), np.uint64)
                    mask[hits] = masks[np.searchsorted(set_, h[hits])]
                    owner = w.row[at]
                    for r in np.unique(owner[hits]):
                        a, z = np.searchsorted(owner, [r, r + 1])
                        here = np.bitwise_or.reduce(mask[a:z])
                        for n, floor in least.items():
                            if min(n, K) != k or not here & bit[n]:
                                continue
                            total = np.concatenate([[0], np.cumsum(weight[a:z] * (mask[a:z] & bit[n] != 0))])
                            m = min(n - k + 1, z - a)
                            start = np.flatnonzero(total[m:] - total[:-m] >= THRESHOLD * floor)
                            if not len(start):
                                continue
                            lo, hi = start[0], start[-1] + m
                            fp = fingerprints(h[a + lo:a + hi], weight[a + lo:a + hi], start - lo, start - lo + m)
                            for s, (x, y) in zip(start.tolist(), fp.view(np.int64).tolist(), strict=True):
                                rows.append((int(rid[first + r]), ids[first + r].as_py(), s, n, x, y, h[a + s:a + s + m].tobytes(), weight[a + s:a + s + m].tobytes()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["_row", "doc_id", "first", "size", "low", "high", "grams", "weights"])

    return run


def _verify(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            n, grams, weights = b.column("item").to_pylist(), b.column("grams").to_pylist(), b.column("weights").to_pylist()
            sim = [similarity(np.frombuffer(g, np.uint64), np.frombuffer(w, np.int64), items[i][2], items[i][3]) for i, g, w in zip(n, grams, weights, strict=True)]
            keep = pa.array([s >= THRESHOLD for s in sim])
            cols = [b.column("_row"), b.column("doc_id"), pa.array([items[i][0] for i in n], pa.int64()), pa.array(sim, pa.float64()), b.column("first"), b.column("size").cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["_row", "doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each contaminated document and item."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("_row", "doc_id", "text")
    every = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n_blocks = max(1, -(-every.count() // ITEM_BLOCK))
    found = None
    for block in range(n_blocks):
        part = every.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        items = _items([(r.item_id, r.text) for r in part.collect()])
        shared = spark.sparkContext.broadcast(items)
        windows = scratch.table(rows.mapInArrow(_windows(shared), _WINDOW) if items else spark.createDataFrame([], _WINDOW), f"windows{block}")
        prints = []
        for i, (_, n, h, wt) in enumerate(items):
            low, high = fingerprints(h, wt, np.array([0]), np.array([len(h)])).view(np.int64)[0].tolist()
            prints.append((i, n, low, high))
        index = spark.createDataFrame(prints, "item int, n int, item_low long, item_high long")
        widths = np.tile(np.diff(_BOUNDS), 2).tolist()
        values = F.array(*[F.array(*[F.lit(v) for v in near_values(w)]) for w in widths])
        index = index.select("*", F.posexplode(_pieces(F.col("item_low"), F.col("item_high"))).alias("block", "piece"))
        index = index.withColumn("flip", F.explode(F.get(values, F.col("block")))).select("item", "n", "item_low", "item_high", "block", F.col("piece").bitwiseXOR(F.col("flip")).alias("value"))
        index = scratch.table(index, f"index{block}")
        small = len(prints) * sum(len(near_values(w)) for w in widths) <= INDEX_ROWS
        narrow = windows.select("_row", "first", "size", "low", "high", F.posexplode(_pieces(F.col("low"), F.col("high"))).alias("k", "v"))
        near = narrow.join(F.broadcast(index) if small else index, (F.col("size") == F.col("n")) & (F.col("k") == F.col("block")) & (F.col("v") == F.col("value")))
        apart = F.bit_count(F.col("low").bitwiseXOR(F.col("item_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("item_high")))
        near = near.where(apart <= RADIUS).select(F.col("_row").alias("r"), F.col("first").alias("f"), F.col("size").alias("s"), "item").distinct()
        pairs = windows.join(near, (F.col("_row") == F.col("r")) & (F.col("first") == F.col("f")) & (F.col("size") == F.col("s")))
        checked = pairs.select("_row", "doc_id", "first", "size", "item", "grams", "weights").mapInArrow(_verify(shared), "_row long, doc_id long, item_id long, similarity double, first_word long, n_words long")
        checked = scratch.table(checked, f"checked{block}")
        scratch.drop(f"windows{block}", f"index{block}")
        found = checked if found is None else found.unionByName(checked)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"), "n_words")).alias("b")
    return found.groupBy("_row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", (-F.col("b.at")).alias("first_word"), "b.n_words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents; documents without doc_id stay."""
    return without_ids(docs, contaminated(docs, benchmark).select("doc_id"))
