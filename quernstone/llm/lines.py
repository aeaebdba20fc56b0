"""Line dedup by distinct-site spread.

Each non-blank line is keyed by two 64-bit hashes; a HyperLogLog sketch of the
sites that carry it merges by aggregation. Lines whose estimate is clearly over
the threshold are boilerplate; those near it get an exact distinct count. All
occurrences of boilerplate are removed, whatever the site.

A document whose non-blank lines are all boilerplate keeps its text, as nothing
would be left of it; document dedup handles copies. Any own line, however short
beside the boilerplate, is enough for the removal.

Null text: stays null. Empty text and blank lines: never removed. Null source
counts as the site ''. Null doc_id: told by its text. Repeated rows get equal
results. Very long texts take time in proportion to their lines. An empty table
gives no row. Extra columns are kept, but for n_lines and n_removed, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 10
#: Registers of a sketch, as a power of two, and how far from the threshold an estimate is trusted.
LG_K, MARGIN = 12, 0.15
#: A line's rows are spread over this many join keys.
SALTS = 64


def _lines(docs: DataFrame, *cols: str | Column) -> DataFrame:
    line = docs.select(*cols, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.trim("line") != "")
    return line.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(7), "line"))


def boilerplate_keys(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (k1, k2) of lines that at least min_sites distinct sites carry."""
    lines = _lines(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"))
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
    spread = spread.where(F.col("estimate") >= min_sites * (1 - MARGIN))
    sure = F.col("estimate") > min_sites * (1 + MARGIN)
    near = spread.where(~sure).select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("site"), F.lit(SALTS)).cast("int"))
    # lines near the threshold alone are made distinct by site
    near = near.withColumnRenamed("salt", "near_salt")
    pairs = salted.select("k1", "k2", "salt", "site").join(near, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")) & (F.col("salt") == F.col("near_salt")), "left_semi")
    exact = pairs.distinct().groupBy("k1", "k2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(sure).select("k1", "k2").unionByName(exact.select("k1", "k2"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_removed (longs) beside."""
    docs = docs.drop("n_lines", "n_removed")
    doc, text, hits, lines_, bounds, left, goes = free_names(docs, "doc", "text_key", "hits", "lines", "bounds", "left", "goes")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(doc), F.xxhash64("text").alias(text)]
    keys = boilerplate_keys(docs, min_sites).select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("b_salt"))
    lines = _lines(docs, *key).withColumn("salt", F.pmod(F.xxhash64(doc, "line_no"), F.lit(SALTS)).cast("int"))
    lines = lines.select(doc, text, "line_no", "k1", "k2", "salt")
    found = lines.join(keys, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")) & (F.col("salt") == F.col("b_salt")), "left_semi")
    by_doc = found.groupBy(F.col(doc).alias(f"{doc}2"), F.col(text).alias(f"{text}2")).agg(F.sort_array(F.collect_set("line_no")).alias(hits))
    out = docs.select("*", *key).join(by_doc, (F.col(doc) == F.col(f"{doc}2")) & (F.col(text) == F.col(f"{text}2")), "left")
    out = out.withColumn(lines_, F.split("text", "\n", -1))
    out = out.withColumn(bounds, F.when(F.col(hits).isNotNull(), F.concat(F.array(F.lit(-1)), hits, F.array(F.size(lines_)))))
    # the lines between each hit and the next
    gap = lambda i: F.slice(F.col(lines_), F.get(F.col(bounds), i) + 2, F.get(F.col(bounds), i + 1) - F.get(F.col(bounds), i) - 1)
    out = out.withColumn(left, F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits)), gap)))
    out = out.withColumn(goes, F.coalesce(F.exists(left, lambda x: F.trim(x) != ""), F.lit(False)))
    return out.select(
        *[F.when(F.col(goes), F.array_join(left, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines_), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(goes), F.size(hits)).otherwise(0).cast("long").alias("n_removed"),
    )
