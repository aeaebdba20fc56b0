"""Validation rules and reports: each rule is DataFrame -> findings (code, severity, subject, detail)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import SEVERITIES, STATUSES, squash

Rule = Callable[[DataFrame], DataFrame]


def finding(df: DataFrame, code: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Bag union of the rules' findings."""
    return reduce(DataFrame.unionByName, [r(df) for r in rules])


def blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


def missing_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with required fields that are null or blank, and which."""
    lacking = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in columns]))
    return df.withColumn("missing", F.array_join(lacking, ",")).where(F.size(lacking) > 0)


def invalid_status(df: DataFrame, column: str = "status", allowed: list[str] = STATUSES) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def repeated(df: DataFrame, keys: list[str], member: str, *, least: int = 2) -> DataFrame:
    """Groups of keys with at least `least` rows: n and the sorted distinct members."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(member)).alias("members")).where(F.col("n") >= least)


def repeated_keys(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """As repeated, without members; partial counts only, so hot keys cost nothing."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def repeated_purposes(df: DataFrame, purpose: str, active: Column) -> DataFrame:
    """Normalised purposes of active rows that occur more than once."""
    return df.where(active).select(squash(F.col(purpose)).alias("purpose")).where("purpose is not null").groupBy("purpose").agg(F.count("*").alias("n")).where("n > 1")


def suppressed(groups: DataFrame, members: DataFrame, policy: DataFrame, key: str, subject: str) -> DataFrame:
    """Groups without those of which some member has a policy entry with a reason."""
    excused = members.join(policy.where(~blank("reason")).select(subject), subject, "left_semi").select(key).distinct()
    return groups.join(excused, key, "left_anti")


def group_size(df: DataFrame, keys: list[str], strength: str) -> DataFrame:
    """Rows with their group's size, and the verdict yes (strong), check (weak) or no (alone)."""
    n = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("group_size"))  # counts first: a window would sort each group in one task
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = df.join(n, same).drop(*[f"_{k}" for k in keys])
    verdict = F.when(F.col("group_size") < 2, "no").when(F.col(strength) == "strong", "yes").otherwise("check")
    return out.withColumn("duplicated", verdict)


def keep_best(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row per key with the least values in the given columns, by a partial aggregate; `-column` is the greatest instead."""
    rank = F.struct(*[(-F.col(o[1:]) if o.startswith("-") else F.col(o)).alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows per key, numbered."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("seq") <= most)


def report(findings: DataFrame) -> DataFrame:
    """One row: counts by severity, and whether nothing blocks."""
    count = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    return findings.agg(F.count("*").alias("n"), *count).withColumn("allowed", F.col("n_block") == 0)


def status_rollup(findings: DataFrame, dimensions: dict[str, list[str]]) -> DataFrame:
    """Per dimension: fail if a blocking finding has one of its codes, warn for any other such finding, else ok."""
    spark = findings.sparkSession
    codes = spark.createDataFrame([(d, c) for d, cs in dimensions.items() for c in cs], "dimension string, code string")
    hit = codes.join(findings, "code", "left").groupBy("dimension").agg(F.bool_or(F.col("severity") == "block").alias("b"), F.count("severity").alias("n"))
    return hit.select("dimension", F.when(F.coalesce("b", F.lit(False)), "fail").when(F.col("n") > 0, "warn").otherwise("ok").alias("state"))


def projection_mismatch(df: DataFrame, raw: str, columns: list[str], key: str) -> DataFrame:
    """Columns that disagree with the JSON they were taken from."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("stored"), F.get_json_object(raw, f"$.{c}").alias("raw")) for c in columns]))
    return df.select(key, pairs.alias("p")).where(~F.col("p.stored").eqNullSafe(F.col("p.raw"))).select(key, "p.field", "p.stored", "p.raw")


def without_same_sets(groups: DataFrame, others: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n) of the groups whose set of members is the set of no other grouping; n is its size.

    Both frames have a row for each group and member; repeated rows and null members
    add nothing, and a group of null members alone has the empty set. A set meets the
    others of its size and digest (two exclusive ors of hashes, so that partial
    aggregates suffice and no set is ever in one place); whether all its members are in
    the least of them is then looked up.
    """
    sets = [df.select(F.col(group).alias("_g"), F.col(member).alias("_m")).distinct() for df in (groups, others)]
    digest = [F.coalesce(F.bit_xor(F.when(F.col("_m").isNotNull(), F.xxhash64("_m", F.lit(salt)))), F.lit(0)).alias(f"_h{salt}") for salt in (1, 2)]
    own, theirs = (d.groupBy("_g").agg(F.count("_m").alias("n"), *digest) for d in sets)
    least = theirs.groupBy("n", "_h1", "_h2").agg(F.min("_g").alias("_o"))
    met = own.join(least, ["n", "_h1", "_h2"]).select("_g", "_o")
    inside = sets[1].select(F.col("_g").alias("_o"), "_m")
    differ = met.join(sets[0].where("_m is not null"), "_g").join(inside, ["_o", "_m"], "left_anti").select("_g").distinct()
    same = met.select("_g").join(differ, "_g", "left_anti")
    return own.join(same, "_g", "left_anti").select(F.col("_g").alias(group), "n")


def incomplete_by_kind(df: DataFrame, kind: str, required: dict[str, list[str]], *, default: str, always: list[str]) -> DataFrame:
    """df with `missing`, the fields that a record of its kind needs and that are null or '', for the records that lack any.

    The kind is compared without outer blanks and case; null and '' count as default.
    Kinds that are not listed need the fields of `always` alone. Fields may be paths
    into structs; a null struct lacks all of its own.
    """
    name = F.coalesce(F.nullif(F.lower(F.trim(kind)), F.lit("")), F.lit(default))
    lacks = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    asked = [F.when(lacks(c), F.lit(c)) for c in always]
    asked += [F.when((name == k) & lacks(c), F.lit(c)) for k, columns in required.items() for c in columns if c not in always]
    return df.withColumn("missing", F.array_compact(F.array(*asked))).where(F.size("missing") > 0)


def plan_errors(nodes: DataFrame, edges: DataFrame, known: list[str]) -> DataFrame:
    """Repeated ids, dangling and self edges, unknown relationships of a plan."""
    twice = repeated_keys(nodes, ["id"]).select(F.lit("DUPLICATE_ID").alias("code"), F.col("id").cast("string").alias("subject"))
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    lost = edges.join(ids, F.col("target") == F.col("_id"), "left_anti").select(F.lit("DANGLING_EDGE").alias("code"), F.concat_ws(">", "source", "target").alias("subject"))
    own = edges.where("source = target").select(F.lit("SELF_EDGE").alias("code"), F.col("source").cast("string").alias("subject"))
    odd = edges.where(~F.col("relationship").isin(known)).select(F.lit("UNKNOWN_RELATIONSHIP").alias("code"), F.col("relationship").alias("subject"))
    return twice.unionByName(lost).unionByName(own).unionByName(odd)
