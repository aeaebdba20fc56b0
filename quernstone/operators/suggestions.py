"""Lookups, buckets and suggestions over records: fingerprints, leave-one-out scores, purposes, slots, stored changes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import scalars as s

#: Texts of at least this many bytes are stored compressed.
COMPRESS_FROM = 256


def encoded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, plain, packed): a text as it is, if short, else its zlib bytes."""
    rows = df.select(key, F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            short = [len(r) < COMPRESS_FROM for r in raw]
            packed = [r if p else zlib.compress(r, 9) for r, p in zip(raw, short, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short), pa.array(packed, pa.binary())], names=[key, "plain", "packed"])

    return rows.where("text is not null").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, plain boolean, packed binary")


def decoded(df: DataFrame, key: str) -> DataFrame:
    """(key, plain, text) of what encoded() gave."""
    rows = df.select(key, "plain", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(p if plain else zlib.decompress(p)).decode() for plain, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[key, "plain", "text"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, plain boolean, text string")


def in_many(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, places) of keys that stand in more than one place, sorted."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(place)).alias("places")).where(F.size("places") > 1)


def repeated(rows: DataFrame, key: str, *, more_than: int = 1) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def bucketed(rows: DataFrame, shard: Column, key: str) -> DataFrame:
    """(shard, ids) of the buckets, ids sorted."""
    return rows.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def impact_objects(closures: DataFrame, *, inline: int) -> DataFrame:
    """(id, closure_size, closure, component): small closures (id, member) inline, larger ones as the digest of their sorted component, itself included."""
    got = closures.groupBy("id").agg(F.sort_array(F.collect_set("member")).alias("c"))
    whole = F.array_sort(F.array_union("c", F.array("id")))
    small = F.size("c") <= inline
    return got.select("id", F.size("c").alias("closure_size"), F.when(small, F.col("c")).alias("closure"), F.when(~small, F.sha2(F.array_join(whole.cast("array<string>"), ","), 256)).alias("component"))


def lookup(rows: DataFrame, key: str) -> DataFrame:
    """The record of that uid, else the first of that external id."""
    hit = rows.where((F.col("uid") == key) | (F.col("external_id") == key))
    return hit.orderBy(F.desc(F.col("uid") == key), "uid").limit(1)


def bounded_scan(rows: DataFrame, equal: dict[str, object], search: str | None, searched: list[str], order: list[str], *, after: tuple | None = None, limit: int = 100) -> DataFrame:
    """Records that equal and hold what is asked, behind a place in the order, up to a limit of 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be in [1, 1000]")
    out = rows
    for c, v in equal.items():
        out = out.where(F.col(c) == F.lit(v))
    if search:
        pattern = f"%{search}%" if not any(x in search for x in "\\%_") else "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        found = F.lit(False)
        for c in searched:
            found = found | F.col(c).ilike(pattern)
        out = out.where(found)
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for c, v in zip(order, after, strict=True):
            behind, same = behind | (same & (F.col(c) > F.lit(v))), same & (F.col(c) == F.lit(v))
        out = out.where(behind)
    return out.orderBy(*order).limit(limit)


def with_origin(rows: DataFrame, origin: DataFrame, default: str) -> DataFrame:
    """rows with the source that an origin (id, source) tells, else a default one."""
    return rows.join(origin.select(F.col("id").alias("oid"), "source"), F.col("id") == F.col("oid"), "left").drop("oid").withColumn("source", F.coalesce("source", F.lit(default)))


def fingerprint(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, token, weight): tokens of several lists, weighted by list and added up."""
    def weighted(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(weights[c]).alias("weight")))

    lists = [weighted(c) for c in weights]
    return rows.select(key, F.explode(F.concat(*lists)).alias("t")).groupBy(key, F.col("t.token").alias("token")).agg(F.sum("t.weight").alias("weight"))


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(id, domain, score): shared weight of each record (id, domain, token, weight) with each domain's profile, its own part taken off that of its own domain."""
    own = rows.groupBy("id", "domain", "token").agg(F.sum("weight").alias("weight"))
    profile = own.groupBy(F.col("domain").alias("pd"), F.col("token").alias("pt")).agg(F.sum("weight").alias("pw"))
    met = own.join(profile, F.col("token") == F.col("pt"))
    left = F.col("pw") - F.when(F.col("pd") == F.col("domain"), F.col("weight")).otherwise(0.0)
    return met.where(left > 0).groupBy("id", F.col("pd").alias("domain")).agg(F.sum(F.least("weight", left)).alias("score"))


def distinct_slots(slots: DataFrame) -> DataFrame:
    """(id, slot, text): texts in one form; a slot of the same meaning as one before becomes a dash, as do empty ones."""
    plain = slots.withColumn("text", s.squash(F.col("text")))
    n = F.row_number().over(Window.partitionBy("id", "text").orderBy("slot"))
    return plain.withColumn("n", n).select("id", "slot", F.when(F.col("text").isNull() | (F.col("n") > 1), "-").otherwise(F.col("text")).alias("text"))


def existing_purpose(units: DataFrame, known: DataFrame, lookups: list[str]) -> DataFrame:
    """(id, text): for units (id, action, object) the first known purpose (ord, action, object, text) of the same action and object, else, among lookups, the one that shares most words with the object, two at least.

    Objects are compared once for each set of words: of known purposes with the same
    words only the first can be chosen, and units with the same words get the same one.
    """
    first = F.min_by(F.struct("ord", "text"), F.struct(F.col("ord").isNull(), "ord")).alias("p")
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    exact = known.groupBy(F.col("action").alias("ka"), F.col("object").alias("ko")).agg(first).select("ka", "ko", F.col("p.text").alias("exact"))
    mine = units.withColumn("words", F.when(F.col("action").isin(lookups), words("object")))
    theirs = known.where(F.col("action").isin(lookups)).groupBy(words("object").alias("kw")).agg(first)
    left = mine.select("words").where("words is not null").distinct().select("words", F.explode("words").alias("w"))
    right = theirs.select("kw", "p", F.explode("kw").alias("w"))
    shared = left.join(right, "w").groupBy("words", "kw").agg(F.count("*").alias("n"), F.first("p").alias("p")).where("n > 1")
    near = shared.groupBy("words").agg(F.max_by("p.text", F.struct("n", -F.col("p.ord"))).alias("near")).withColumnRenamed("words", "met")
    found = mine.join(exact, (F.col("action") == F.col("ka")) & (F.col("object") == F.col("ko")), "left").join(near, F.col("words") == F.col("met"), "left")
    return found.select("id", F.coalesce("exact", "near").alias("text")).where("text is not null")


def purpose_facts(rows: DataFrame, key: str, symbol: Column, docstring: Column, actions: dict[str, str]) -> DataFrame:
    """(key, action, object, qualifiers): the first word of the symbol's last part and the rest of it, with the phrases of the docstring's first sentence."""
    words = s.identifier_tokens(s.last_part(symbol))
    said = s.sentence_words(s.first_sentence(docstring))
    action = s.alias_of(F.coalesce(F.get(words, 0), F.get(said, 0)), actions)
    rest = F.nullif(F.array_join(F.slice(words, 2, 99), " "), F.lit(""))
    return rows.select(key, action.alias("action"), F.coalesce(rest, F.array_join(F.slice(said, 2, 99), " ")).alias("object"), F.array_join(s.qualifiers(s.first_sentence(docstring)), ",").alias("qualifiers"))
