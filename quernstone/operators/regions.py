"""Regions of texts as operations on line rows: heading sections and marked regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, line): the lines of each text, from 1."""
    return df.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("no", "line")).withColumn("no", F.col("no") + 1)


def _joined(rows: DataFrame, key: str, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("no", "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p.line), "\n").alias(name))


def sections(rows: DataFrame, key: str, heading: str) -> DataFrame:
    """(key, section): from a heading, found without regard to case, to before the next of the same level or above; texts where the heading is missing or not unique give nothing."""
    level, title = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)), F.trim(F.regexp_replace("line", r"^#{1,6}\s+|\s+#*$", ""))
    wanted = (F.col("_level") > 0) & (F.lower(title) == heading.lower())
    text = Window.partitionBy(key)
    # a text's lines are shuffled once: bounds stand beside them, and are not joined to them
    starts = rows.where(F.col(key).isNotNull()).withColumn("_level", level).withColumn("_start", F.when(wanted, F.struct("no", "_level")))
    starts = starts.withColumn("_n", F.count("_start").over(text)).withColumn("_first", F.min("_start").over(text)).where("_n = 1 and no >= _first.no")
    ends = F.when((F.col("_level") > 0) & (F.col("no") > F.col("_first.no")) & (F.col("_level") <= F.col("_first._level")), F.col("no"))
    inside = starts.withColumn("_end", F.min(ends).over(text)).where("_end is null or no < _end")
    return _joined(inside, key, "section")


def marked(rows: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """(key, region): the lines between the first line that holds begin and the next that holds end."""
    text = Window.partitionBy(key)
    starts = rows.where(F.col(key).isNotNull()).withColumn("_first", F.min(F.when(F.col("line").contains(begin), F.col("no"))).over(text)).where("no > _first")
    inside = starts.withColumn("_end", F.min(F.when(F.col("line").contains(end), F.col("no"))).over(text)).where("no < _end")
    return _joined(inside, key, "region")
