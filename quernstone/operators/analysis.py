"""Effects, scores and bulk edits over record tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut
from .ordering import placed

#: Weights of shared grams by their length, and the least score.
GRAM_WEIGHTS, LEAST_SCORE = {1: 2.0, 2: 5.0, 3: 8.0}, 6.0

def effect_priority(action: Column, resource: Column, target: Column, confidence: Column) -> Column:
    """Score of an effect: what it names, how sure it is, less for plain access, memory and values."""
    plus = F.when(action.isNotNull(), 40).otherwise(0) + F.when(resource.isNotNull(), 30).otherwise(0) + F.when(target.isNotNull(), 20).otherwise(0) + F.when(confidence == "high", 10).otherwise(0)
    minus = F.when(action.isin("access", "read"), 15).otherwise(0) + F.when(resource.isin("memory", "value"), 30).otherwise(0) + F.when(action == "parse", 20).otherwise(0)
    return plus - minus


def comparable(action: Column, resource: Column) -> Column:
    return ~action.isin("access", "parse", "read", "serialize") & ~resource.isin("memory", "terminal", "ui", "value")


def primary(effects: DataFrame, unit: str, score: str, order: str) -> DataFrame:
    """Each unit's effect of the highest score, the first on ties, by a partial aggregate."""
    rest = [c for c in effects.columns if c != unit]
    best = F.max(F.struct(F.col(score).alias("_s"), (-F.col(order)).alias("_o"), *[F.col(c).alias(c) for c in rest])).alias("_b")
    return effects.groupBy(unit).agg(best).select(unit, *[F.col(f"_b.{c}").alias(c) for c in rest])


def same_outcome(effects: DataFrame, unit: str, keys: list[str], *, least: int = 2, most: int | None = None) -> DataFrame:
    """Groups of units by outcome key, at least `least` (and at most `most`) of them."""
    out = effects.groupBy(*keys).agg(F.count_distinct(unit).alias("n")).where(F.col("n") >= least)
    return out if most is None else out.where(F.col("n") <= most)


def gram_profile(rows: DataFrame, label: str, tokens: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(label, size, gram, weight): how often each gram of tokens stands under a label."""
    from quernstone.functions.scalars import ngrams

    each = F.array(*[F.struct(F.lit(n).alias("size"), ngrams(F.col(tokens), n).alias("grams")) for n in sizes])
    long = rows.select(label, F.explode(each).alias("e")).select(label, "e.size", F.explode("e.grams").alias("gram"))
    return long.groupBy(label, "size", "gram").agg(F.count("*").alias("weight"))


def profile_scores(items: DataFrame, profile: DataFrame, item: str, label: str) -> DataFrame:
    """(item, label, score): per shared gram, its size's weight times the lesser count."""
    factor = F.create_map(*[F.lit(x) for kv in GRAM_WEIGHTS.items() for x in kv])
    p = profile.withColumnRenamed("weight", "pw")
    both = items.join(p, ["size", "gram"])
    score = F.sum(F.try_element_at(factor, F.col("size")) * F.least("weight", "pw"))
    return both.groupBy(item, label).agg(score.alias("score")).where(F.col("score") >= LEAST_SCORE)


#: Grams that are broadcast to those who count them, 16 bytes each; more are joined.
FEW_GRAMS = 1_000_000
#: Rows of an Arrow batch, and words that are counted at once (a longer row makes its own slice); bound a worker's memory.
ARROW_ROWS, WORDS = 1000, 1 << 18


def _slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most so many words in column `words`, or of one row."""
    for b in batches:
        ends = np.cumsum(np.nan_to_num(b.column(words).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        first = 0
        while first < b.num_rows:
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + WORDS, side="right")), first + 1)
            yield b.slice(first, last - first)
            first = last


def _grams(lists: pa.ListArray, sizes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(row, size, h1, h2) of every gram of each row's words; a gram is told by its size and two 64-bit hashes."""
    words = lists.flatten().dictionary_encode()
    known, at = words.dictionary.to_numpy(zero_copy_only=False), words.indices.to_numpy(zero_copy_only=False)
    length = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    row, out = np.repeat(np.arange(len(length)), length), []
    word = [pd.util.hash_array(known, hash_key=key, categorize=False)[at] if len(at) else np.zeros(0, np.uint64) for key in ("0123456789abcdef", "fedcba9876543210")]
    for n in sizes:
        first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
        h = [np.full(len(first), n, np.uint64) for _ in word]
        with np.errstate(over="ignore"):
            for i in range(n):
                for k, w in enumerate(word):
                    x = (h[k] ^ w[first + i]) * np.uint64(0x9E3779B97F4A7C15)
                    h[k] = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        out.append((row[first], np.full(len(first), n, np.int32), *h))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _counted(owner: np.ndarray, size: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, size, h1, h2, count) of distinct rows."""
    with np.errstate(over="ignore"):
        mixed = (h1 ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0x94D049BB133111EB)
    for order in (lambda: np.argsort(mixed), lambda: np.lexsort((h2, h1, size, owner))):
        at = order()
        cols = [x[at] for x in (owner, size, h1, h2)]
        new = np.ones(len(at), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in cols], axis=0)
        # rows of one mixed value are the same row, but for a clash about once in 2**64 pairs
        if len(at) == 0 or not (new[1:] & (mixed[at][1:] == mixed[at][:-1])).any():
            break
    first = np.flatnonzero(new)
    return (*(x[first] for x in cols), np.diff(np.concatenate([first, [len(at)]])))


def _of_labels(sizes: tuple[int, ...]):
    """(label, size, h1, h2) of the distinct grams of each label in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            row, size, h1, h2 = _grams(b.column(1), sizes)
            code, size, h1, h2, _ = _counted(codes.indices.to_numpy()[row], size, h1, h2)
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(code)), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["label", "size", "h1", "h2"])

    return run


def _of_items(sizes: tuple[int, ...], wanted=None):
    """(item, label, size, h1, h2, weight) of each row's distinct grams; of wanted ones, sorted by h1, alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2):
            row, size, h1, h2 = _grams(b.column(2), sizes)
            if wanted is not None:
                known = wanted.value
                at = np.minimum(np.searchsorted(known, h1.view(np.int64)), max(len(known) - 1, 0))
                keep = known[at] == h1.view(np.int64) if len(known) else np.zeros(len(h1), bool)
                row, size, h1, h2 = row[keep], size[keep], h1[keep], h2[keep]
            row, size, h1, h2, n = _counted(row, size, h1, h2)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n, pa.int64())], names=["item", "label", "size", "h1", "h2", "weight"])

    return run


def label_scores(rows: DataFrame, item: str, label: str, tokens: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(item, label, score): what profile_scores() gives for the grams of each item and the profiles of all labels.

    An item's counts are at most those of its own label, so that its own score is
    the number of its grams by size, and needs no count. For the others only grams
    that stand under several labels matter: a first reading finds them, a second
    counts them by item. Items that come in several rows go the general way.
    """
    if not rows.groupBy(item).count().where("count > 1").isEmpty():
        return profile_scores(gram_profile(rows, item, tokens, sizes), gram_profile(rows, label, tokens, sizes), item, label)
    spark, n_tokens = rows.sparkSession, F.coalesce(F.size(tokens), F.lit(0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    own = rows.select(item, label, sum(F.greatest(n_tokens - (n - 1), F.lit(0)) * F.lit(GRAM_WEIGHTS[n]) for n in sizes).alias("score"))
    given = rows.select(F.col(item).alias("item"), F.col(label).alias("label"), F.col(tokens).alias("tokens"))
    kinds, gram = dict(given.dtypes), ["size", "h1", "h2"]
    spread = given.select("label", "tokens").mapInArrow(_of_labels(sizes), f"label {kinds['label']}, size int, h1 long, h2 long")
    # numbers alone, so that the aggregate hashes; a null label has a number too
    spread = spread.groupBy(*gram).agg(F.min(F.xxhash64("label")).alias("lo"), F.max(F.xxhash64("label")).alias("hi"))
    several = _cut(spread.where("lo <> hi").select(*gram))
    few = several.count() <= FEW_GRAMS
    wanted = spark.sparkContext.broadcast(np.sort(several.select("h1").toArrow().column(0).to_numpy())) if few else None
    counts = given.mapInArrow(_of_items(sizes, wanted), f"item {kinds['item']}, label {kinds['label']}, size int, h1 long, h2 long, weight long")
    counts = _cut(counts.join(F.broadcast(several) if few else several, gram, "left_semi"))
    theirs = counts.groupBy(F.col("label").alias("_label"), *gram).agg(F.sum("weight").alias("pw"))
    factor = F.coalesce(*[F.when(F.col("size") == n, w) for n, w in GRAM_WEIGHTS.items()], F.lit(0.0))
    other = counts.join(theirs, gram).where(~F.col("label").eqNullSafe(F.col("_label")))
    other = other.groupBy(F.col("item").alias(item), F.col("_label").alias(label)).agg(F.sum(factor * F.least("weight", "pw")).alias("score"))
    return own.unionByName(other).where(F.col("score") >= LEAST_SCORE)


def top_labels(scores: DataFrame, item: str, label: str, most: int = 3) -> DataFrame:
    order = Window.partitionBy(item).orderBy(F.desc("score"), label)
    return scores.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= most)


def mutate(df: DataFrame, operation: str, column: str, where: Column, *, value: object = None, other: str | None = None) -> DataFrame:
    """Bulk edit under a predicate: set, default, remove, rename or replace of a column."""
    c, where = F.col(column), F.coalesce(where, F.lit(False))
    if operation == "set":
        return df.withColumn(column, F.when(where, F.lit(value)).otherwise(c))
    if operation == "default":
        return df.withColumn(column, F.when(where & c.isNull(), F.lit(value)).otherwise(c))
    if operation == "remove":
        return df.withColumn(column, F.when(~where, c))
    if operation == "replace":
        return df.withColumn(column, F.when(where & (c == F.lit(other)), F.lit(value)).otherwise(c))
    if operation == "rename":
        return df.withColumn(other, F.when(where, c).otherwise(F.col(other) if other in df.columns else F.lit(None).cast(df.schema[column].dataType))).withColumn(column, F.when(~where, c))
    raise ValueError(f"unknown operation {operation}")


def compact_profiles(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Dictionary of column tuples that occur often enough: profile names by rank, most frequent first."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = placed(n.withColumn("_often", -F.col("n")), [], ["_often", *columns], "_place")
    return out.withColumn("profile", F.concat(F.lit("profile_"), F.col("_place").cast("string"))).drop("_often", "_place")


def effective(explicit: Column, *inherited: Column) -> Column:
    """The explicit value, else the first inherited one."""
    return F.coalesce(explicit, *inherited)
