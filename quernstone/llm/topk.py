"""Exact top-k by inner product with sorted lists and no random access.

Vectors become integers, floor(256 * x). A block of candidates keeps, per
dimension, its rows sorted by value. A query reads each list from the end that
suits its own component's sign, in rounds: round p reads on until what is left of
a list lies within p / 16 of its span from its worst value. What was read of a row,
above the worst values, raises its lower bound; its upper bound is that and p / 16
of the spans of the lists in which it was not met yet. Both are running sums to
which each entry is added once, when it is read. Rows whose upper bound falls below
the k-th best lower bound leave; a query stops reading once few rows are left, and
only those get their scores resolved in full.

Queries of a batch read together: what a round reads is laid out row by row, and its
share of the sums is a product with the queries; rows that left for all queries of
the batch are no longer part of it. Sums are of integers, in floats as long as
these hold them exactly, else in 64-bit integers.

Candidates are dealt to blocks once and sorted once; the queries, distinct by
vec_id, are sent to every block and stream past its lists. A task holds one block
and a batch of queries. Each block gives at most k rows per query, which a last
top-k merges.

A null vector, or one with a null or non-finite component, takes no part; nor do
a null vec_id and an empty vector. Vectors of another length than a query's are no
candidates for it. Ties go to the smaller vec_id. Repeated vec_ids are candidates
on their own; a repeated query row changes nothing, and of several vectors under a
query's vec_id the smallest, component by component, is the query. Extra columns
are ignored. An empty table gives no row. Components and scores that need more than
62 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tune

K = 5
SCALE = 256
#: Every vec_id that this divides is a query.
QUERY_STEP = 50
#: Components of a block of candidates at most, on average; fewer where a small
#: table is to reach all cores, but LEAST rows at least.
BLOCK_CELLS, LEAST = 1 << 21, 2048
#: Queries that read a block together.
BATCH = 128
#: Rounds, as sixteenths of a list's span that stay unread.
ROUNDS = (8, 6, 5, 4, 3, 2, 0)
#: Reading stops when at most this many rows per query are left.
FEW = 48


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array of long) of the vectors that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False))
    scaled = lambda v: v.cast("double") * SCALE
    fits = lambda v: F.abs(scaled(v)) < float(1 << 62)
    x = F.transform("embedding", lambda v: F.when(fits(v), F.floor(scaled(v)).cast("long")).otherwise(F.raise_error(F.lit("a vector's component does not fit 62 bits")).cast("long")))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


class SortedLists:
    """A block of candidates with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.largest = float(np.abs(x.astype(float)).max())
        if self.largest >= 2**60:
            raise OverflowError("scores do not fit 62 bits")
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.least, self.most = self.values[:, 0], self.values[:, -1]
        self.span = self.most - self.least
        #: Entries read so far, one for each query that reads them.
        self.reads = 0
        self.ends = []
        for p in ROUNDS:
            step = self.span // 16 * p + self.span % 16 * p // 16
            down = [np.searchsorted(v, at, "right") for v, at in zip(self.values, self.least + step, strict=True)]
            up = [np.searchsorted(v, at, "left") for v, at in zip(self.values, self.most - step, strict=True)]
            self.ends.append((p, down, up))

    def top(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (rows, scores) of the block's best, best first."""
        size = self.largest * max(float(np.abs(q.astype(float)).max()), 1.0) * q.shape[1] * 4
        if size >= 2**62:
            raise OverflowError("scores do not fit 62 bits")
        kind = np.float32 if size < 2**24 else np.float64 if size < 2**53 else np.int64
        best = []
        for rows, query in zip(self._outlast(ids, q.astype(kind), k), q, strict=True):
            score = self.x[rows] @ query
            keep = np.lexsort((self.ids[rows], -score))[:k]
            best.append((rows[keep], score[keep]))
        return best

    def _outlast(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows whose bounds leave them a place among its best k."""
        n, kind, out = len(self.ids), q.dtype, [np.zeros(0, np.int64)] * len(q)
        rows, place, left = np.arange(n), None, np.arange(len(q))
        span, dims = self.span.astype(kind), range(q.shape[1])
        sides = [(np.maximum(q, 0), self.least), (np.minimum(q, 0), self.most)]
        low = np.zeros((len(q), n), kind)
        unmet = np.repeat((np.abs(q) @ span)[:, None], n, axis=1)
        alive = ids[:, None] != self.ids[None, :]
        read = [([n] * len(span), [0] * len(span))]
        for p, down, up in self.ends:
            read.append((down, up))
            before = read[-2]
            for (part, worst), first, last in zip(sides, (down, before[1]), (before[0], up), strict=True):
                # what this round reads of the lists; nothing of a row that left
                fresh, met = np.zeros((q.shape[1], len(rows)), kind), np.zeros((q.shape[1], len(rows)), kind)
                for d in dims:
                    at, value = self.order[d, first[d]:last[d]], self.values[d, first[d]:last[d]]
                    if place is not None:
                        at = place[at]
                        at, value = at[at >= 0], value[at >= 0]
                    fresh[d, at], met[d, at] = value - worst[d], span[d]
                    self.reads += len(at) * int(np.count_nonzero(part[:, d]))
                low += part @ fresh
                unmet -= np.abs(part) @ met
            alive &= self._high(low, unmet, p) >= self._kth(low, alive, k)
            stop = alive.sum(1) <= FEW
            for i in np.flatnonzero(stop):
                out[left[i]] = rows[alive[i]]
            if stop.all():
                return out
            keep = alive[~stop].any(0)
            if stop.any() or keep.sum() < 0.9 * len(rows):
                low, unmet, alive = (m[~stop][:, keep] for m in (low, unmet, alive))
                sides, left, rows = [(part[~stop], worst) for part, worst in sides], left[~stop], rows[keep]
                place = np.full(n, -1, np.int32)
                place[rows] = np.arange(len(rows))
        for i, own in zip(left, alive, strict=True):
            out[i] = rows[own]
        return out

    @staticmethod
    def _high(low: np.ndarray, unmet: np.ndarray, p: int) -> np.ndarray:
        """Upper bounds, rounded up."""
        return low + (unmet * low.dtype.type(p / 16) + 1 if low.dtype.kind == "f" else (unmet // 16 + 1) * p)

    @staticmethod
    def _kth(low: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
        """For each query a lower bound that k rows reach: the k-th best of the maxima of groups of rows, neighbours apart."""
        least = -np.inf if low.dtype.kind == "f" else np.iinfo(np.int64).min
        n = low.shape[1]
        if n < k:
            return np.full((len(low), 1), least)
        shown, g = np.where(alive, low, least), min(n, 64 * k)
        whole = n - n % g
        best = shown[:, :whole].reshape(len(low), -1, g).max(1)
        best[:, : n - whole] = np.maximum(best[:, : n - whole], shown[:, whole:])
        return np.partition(best, g - k, axis=1)[:, g - k][:, None]


def _matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (ids, vectors)."""
    ids, col = np.asarray(table.column("vec_id")), table.column("x").combine_chunks()
    size = np.asarray(col.value_lengths())
    flat, at = np.asarray(col.flatten()), np.cumsum(size) - size
    return {int(d): (ids[size == d], flat[at[size == d][:, None] + np.arange(d)]) for d in np.unique(size)}


def _answers(lists: dict[int, SortedLists], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    for d, (qid, q) in _matrix(queries).items():
        if d not in lists:
            continue
        for a in range(0, len(q), BATCH):
            best = lists[d].top(qid[a:a + BATCH], q[a:a + BATCH], k)
            cols = [np.repeat(qid[a:a + BATCH], [len(r) for r, _ in best]), lists[d].ids[np.concatenate([r for r, _ in best])], np.concatenate([s for _, s in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by block, the candidates of each before its queries
        block, parts, lists = None, [], None
        for batch in batches:
            b, asks = np.asarray(batch.column("b")), np.asarray(batch.column("asks"))
            cuts = np.flatnonzero((b[1:] != b[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), len(b)]):
                if lo == hi:
                    continue
                if block != b[lo]:
                    block, parts, lists = b[lo], [], None
                piece = pa.Table.from_batches([batch.slice(lo, hi - lo).select(["vec_id", "x"])])
                if not asks[lo]:
                    parts.append(piece)
                    continue
                if lists is None:
                    lists = {d: SortedLists(*m) for d, m in _matrix(pa.concat_tables(parts)).items()} if parts else {}
                    parts = []
                yield from _answers(lists, piece, k)

    return run


def exact_top_k(vectors: DataFrame, *, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors."""
    spark = vectors.sparkSession
    tune(spark)
    x = quantized(vectors)
    size = x.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("cells")).first()
    blocks = max(1, -(-size.cells // BLOCK_CELLS), min(spark.sparkContext.defaultParallelism, size.n // LEAST))
    # repeated rows of one input partition meet in a block; those of others do not
    dealt = F.pmod(F.xxhash64("vec_id", "x", F.spark_partition_id()), F.lit(blocks)).cast("int")
    lists = x.select("vec_id", "x", dealt.alias("b"), F.lit(0).alias("asks"))
    queries = x.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = queries.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("asks"))
    met = lists.unionByName(queries).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "asks")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
