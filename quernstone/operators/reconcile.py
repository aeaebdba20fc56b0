"""Declared rows against observed rows: drift, candidates, snapshots, pairings, range lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import last_part

#: Kinds that a rule without a kind stands for.
DEFAULT_KINDS = ["class", "function", "method"]


def missing(declared: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Declared keys that nobody observed."""
    return declared.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti")


def undeclared(observed: DataFrame, declared: DataFrame, exempt: list[DataFrame], keys: list[str]) -> DataFrame:
    """Observed keys that are neither declared nor exempt."""
    known = reduce(DataFrame.unionByName, [d.select(*keys) for d in [declared, *exempt]])
    return observed.select(*keys).distinct().join(known, keys, "left_anti")


def drift(declared: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with the side that lacks them, in one full outer join."""
    a, b = declared.select(*keys).distinct().withColumn("_a", F.lit(True)), observed.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull()).select(*keys, F.when(F.col("_b").isNull(), "MISSING_DECLARED").otherwise("UNDECLARED").alias("code"))


def expand_rules(rules: DataFrame, kind: str = "kind") -> DataFrame:
    """A rule without a kind stands for each default kind, nested ones not among them."""
    kinds = F.when(F.col(kind).isNull(), F.array(*map(F.lit, DEFAULT_KINDS))).otherwise(F.array(kind))
    return rules.withColumn(kind, F.explode(kinds))


def name_candidates(lost: DataFrame, units: DataFrame, *, symbol: str, unit_symbol: str, order: str, most: int = 5) -> DataFrame:
    """For each lost row the first units whose symbol ends in the same part."""
    leaf = units.select("*", last_part(F.col(unit_symbol)).alias("_u"))
    first = leaf.withColumn("candidate_no", F.row_number().over(Window.partitionBy("_u").orderBy(order))).where(F.col("candidate_no") <= most)  # a bounded top-k of each leaf, before the join
    return lost.withColumn("_leaf", last_part(F.col(symbol))).join(first, F.col("_leaf") == F.col("_u")).drop("_leaf", "_u")


def unique_candidate(calls: DataFrame, blocks: DataFrame, *, source: str, leaf: str, block: str, block_leaf: str) -> DataFrame:
    """Edges from calls to the only block of that leaf name, self-edges left out."""
    only = blocks.groupBy(F.col(block_leaf).alias("_l")).agg(F.count("*").alias("_n"), F.min(block).alias("target")).where("_n = 1")
    return calls.join(only, F.col(leaf) == F.col("_l")).where(F.col(source) != F.col("target")).select(F.col(source).alias("source"), "target").distinct()


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), after.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where(F.col("change").isNotNull())


def moved(removed: DataFrame, added: DataFrame, digest: str, path: str) -> DataFrame:
    """Removed and added paths of equal content, where the content is unique on both sides."""
    one = lambda df, name: df.groupBy(digest).agg(F.count("*").alias("_n"), F.min(path).alias(name)).where("_n = 1").drop("_n")
    return one(removed, "old_path").join(one(added, "new_path"), digest)


def pair_by_priority(after: DataFrame, before: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """After-rows with the before-row of the first key that matches; unmatched before-rows follow as removed."""
    out = after.withColumn("_row", F.monotonically_increasing_id())
    found: list[Column] = []
    for i, k in enumerate(keys):
        side = before.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(F.struct(*before.columns)).alias(f"_b{i}"))
        out = out.join(side, F.col(k) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_b{i}"))
    out = out.withColumn("_m", F.coalesce(*found))
    id_ = before.columns[0]
    change = F.when(F.col("_m").isNull(), "created").when(~F.col(payload).eqNullSafe(F.col(f"_m.{payload}")), "modified").otherwise("same")
    paired = out.select(F.col(id_).alias("after_id"), F.col(f"_m.{id_}").alias("before_id"), change.alias("change"))
    used = paired.where("before_id is not null").select(F.col("before_id").alias("_used")).distinct()
    gone = before.join(used, F.col(id_) == F.col("_used"), "left_anti").select(F.lit(None).cast(before.schema[id_].dataType).alias("after_id"), F.col(id_).alias("before_id"), F.lit("removed").alias("change"))
    return paired.unionByName(gone)


def at_location(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """Points with every range of their key that holds them; a hash join with a bound check."""
    r = ranges.withColumnRenamed(key, "_key")
    return points.join(r, (F.col(key) == F.col("_key")) & F.col(at).between(F.col(low), F.col(high))).drop("_key")


def declared_over_inferred(declared: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """All declared edges, and inferred ones of pairs that none is declared for."""
    return declared.withColumn("origin", F.lit("declared")).unionByName(inferred.join(declared.select(*keys), keys, "left_anti").withColumn("origin", F.lit("inferred")))


def opposite_actions(effects: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Unordered pairs of units with opposite actions on the same resource and target, one row a pair; see opposed_groups for large groups."""
    both = effects.sparkSession.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "action string, opposite string")
    a = effects.join(F.broadcast(both), "action").select(F.col("unit").alias("a"), "action", "opposite", "resource", "target")
    b = effects.select(F.col("unit").alias("b"), F.col("action").alias("other"), F.col("resource").alias("r"), F.col("target").alias("t"))
    hit = a.join(b, (F.col("opposite") == F.col("other")) & (F.col("resource") == F.col("r")) & (F.col("target") == F.col("t")) & (F.col("a") != F.col("b")))
    return hit.select(F.least("a", "b").alias("first_unit"), F.greatest("a", "b").alias("second_unit"), "resource", "target").distinct()


def opposed_groups(effects: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(resource, target, left_action, right_action, n_left, n_right, left_unit, right_unit): one row for each resource and target that both actions of a pair meet on, with the number of units and the least of each side.

    Partial aggregates alone: as many rows as resources, however many units meet there.
    """
    sides = effects.sparkSession.createDataFrame([(*p, a == p[0], a) for p in pairs for a in p], "left_action string, right_action string, is_left boolean, action string")
    met = effects.where("target is not null").join(F.broadcast(sides), "action").select("unit", "resource", "target", "left_action", "right_action", "is_left").distinct()
    left, right = F.when(F.col("is_left"), F.col("unit")), F.when(~F.col("is_left"), F.col("unit"))
    out = met.groupBy("resource", "target", "left_action", "right_action").agg(F.count(left).alias("n_left"), F.count(right).alias("n_right"), F.min(left).alias("left_unit"), F.min(right).alias("right_unit"))
    return out.where("n_left > 0 and n_right > 0")


def changed_between(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of both snapshots whose value differs, both values beside."""
    b = after.select(F.col(key).alias("_k"), F.col(column).alias("after"))
    return before.join(b, F.col(key) == F.col("_k")).where(~F.col(column).eqNullSafe(F.col("after"))).select(key, F.col(column).alias("before"), "after")
