"""Places of rows in an order, over the whole cluster: no group needs a task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut


def placed(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`, a row's place from 1 in the order of its group; without group, in that of the whole table.

    One range sort deals the rows out by group and order. A row's number within its
    partition, less the number of its group's first row there, plus the group's rows
    in the partitions before, is its place. What is counted has a row for each group
    and partition. Equal rows get places by where they were read.
    """
    sorted_ = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie")
    rows = _cut(sorted_.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    met = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(shift, met).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
