"""Grouped set algebra, choices by precedence, slots and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_members(df: DataFrame, group: str, unit: str, member: str, most: int = 8) -> DataFrame:
    """(group, common): the first members, sorted, that every unit of a group has."""
    units = df.groupBy(group).agg(F.count_distinct(unit).alias("_n"))
    each = df.select(group, unit, member).distinct().groupBy(group, member).agg(F.count("*").alias("_m"))
    every = each.join(units, group).where("_m = _n").groupBy(group).agg(F.slice(F.array_sort(F.collect_list(member)), 1, most).alias("common"))
    return units.select(group).join(every, group, "left").select(group, F.coalesce("common", F.array().cast(f"array<{dict(df.dtypes)[member]}>")).alias("common"))


def all_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members): the sorted union of a group's members."""
    return df.select(group, member).distinct().groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))


def signatures(df: DataFrame, columns: list[str], name: str, *, least_set: int = 2, least: int = 3, examples: int = 5) -> DataFrame:
    """Frequent tuples of columns with at least least_set values set, and their first examples."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    order = Window.partitionBy(*columns).orderBy(name)
    rows = df.where(filled >= least_set).withColumn("_n", F.row_number().over(order))
    out = rows.groupBy(*columns).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.col(name)))).alias("examples"))
    return out.where(F.col("n") >= least)


def top_counts(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """The most frequent values, ties to the smaller one; a bounded top-k."""
    return df.groupBy(key).agg(F.sum(value).alias("n")).orderBy(F.desc("n"), key).limit(most)


def one_value(df: DataFrame, keys: list[str], value: str, *, least: int = 2) -> DataFrame:
    """Groups whose rows all share one value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("_a"), F.max(value).alias("_z")).where((F.col("n") >= least) & F.col("_a").eqNullSafe(F.col("_z"))).select(*keys, "n")


def several_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups that different values claim."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n")).where("n > 1")


def by_precedence(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows with the rank of their kind in a fixed order; unknown kinds come last."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn("rank", F.when(rank > 0, rank - 1).otherwise(F.lit(len(order))).cast("int"))


def choose(df: DataFrame, keys: list[str], explicit: Column, rank: Column, position: str) -> DataFrame:
    """The explicit row per key, else the one of least rank, then position; a partial aggregate."""
    best = F.min(F.struct((~explicit).alias("e"), rank.alias("r"), F.col(position).alias(position)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{position}")


def refill_slots(df: DataFrame, chosen: Column, slot: str, rank: str, value: str, part: list[str]) -> DataFrame:
    """Chosen rows change places among their own slots, in order of rank; the others keep theirs."""
    sel = df.where(chosen)
    a = sel.select(*part, slot, F.row_number().over(Window.partitionBy(*part).orderBy(slot)).alias("_i"))
    b = sel.select(*part, F.col(value).alias(value), F.row_number().over(Window.partitionBy(*part).orderBy(rank, slot)).alias("_i"))
    return df.where(~chosen).select(*part, slot, value).unionByName(a.join(b, [*part, "_i"]).select(*part, slot, value))


def shard_of(path: Column, layers: list[tuple[str, str]], default: str) -> Column:
    """The shard of the first layer whose prefix a path has, as whole components."""
    out = F.lit(default)
    for prefix, shard in reversed(layers):
        out = F.when((path == prefix) | path.startswith(prefix + "/"), F.lit(shard)).otherwise(out)
    return out


def prefix_moves(df: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """(key, old_prefix, new_prefix): for each common suffix of two paths, what stands before it."""
    a, b = F.reverse(F.split(old, "/")), F.reverse(F.split(new, "/"))
    longest = F.least(F.size(a), F.size(b))
    sizes = F.filter(F.sequence(F.lit(1), longest), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))
    before = lambda x, i: F.array_join(F.reverse(F.slice(x, i + 1, F.size(x))), "/")
    pairs = F.transform(sizes, lambda i: F.struct(before(a, i).alias("old_prefix"), before(b, i).alias("new_prefix")))
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.old_prefix", "p.new_prefix").where("old_prefix <> new_prefix")


def parallel_strategies(df: DataFrame, group: str, method: str, parent: str) -> DataFrame:
    """Groups of one method name over several parents that are all strategies."""
    return df.groupBy(group).agg(F.count_distinct(method).alias("m"), F.count_distinct(parent).alias("p"), F.every(F.col(parent).endswith("Strategy")).alias("all")).where("m = 1 and p >= 2 and all").select(group)


def referenced_by_kept(edges: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Targets to be removed that something kept points at."""
    gone = removed.select(F.col(key).alias("_g")).distinct()
    kept = edges.join(gone, F.col("source") == F.col("_g"), "left_anti")
    return kept.join(gone, F.col("target") == F.col("_g"), "left_semi").select("target").distinct()
