"""Invariants by type, and findings of components: dispatch with findings for what cannot be read, coverage, retries, layouts, artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import required_number


def _state(value: Column, limit: Column, holds: Column) -> Column:
    """ok, violation, or the error of either side."""
    error = F.coalesce(value.error, limit.error)
    return F.struct(F.when(error.isNotNull(), "INVARIANT_CONFIGURATION_ERROR").when(~holds, "INVARIANT_VIOLATION").alias("code"), error.alias("error"))


def less_than() -> Column:
    value, limit = required_number(F.col("actual"), "property"), required_number(F.col("max"), "max")
    return _state(value, limit, value.value < limit.value)


def greater_than() -> Column:
    value, limit = required_number(F.col("actual"), "property"), required_number(F.col("min"), "min")
    return _state(value, limit, value.value > limit.value)


#: Handlers by the name of their type.
HANDLERS: dict[str, Callable[[], Column]] = {"value_less_than": less_than, "value_greater_than": greater_than}


def evaluate(invariants: DataFrame, handlers: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """invariants (id, type, and what handlers read) with a finding's code and error, where there is one.

    Types are told in any case, blanks as underscores; custom evidence is left to
    others; a type without a handler is a finding of its own.
    """
    kind = F.replace(F.lower(F.trim("type")), F.lit(" "), F.lit("_"))
    found = F.struct(F.lit("INVARIANT_UNSUPPORTED_TYPE").alias("code"), F.concat(F.lit("Unsupported invariant type '"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("<empty>")), F.lit("'.")).alias("error"))
    for name, make in (handlers or HANDLERS).items():
        found = F.when(kind == name, make()).otherwise(found)
    out = invariants.where(kind != "custom_evidence").withColumn("_f", found)
    return out.withColumn("code", F.col("_f.code")).withColumn("error", F.col("_f.error")).drop("_f").where("code is not null")


def compatible(required: DataFrame, states: DataFrame) -> DataFrame:
    """(id, failures): required (id, component, expected) against states (component, state); a component without a state fails."""
    met = required.join(states.select(F.col("component").alias("c"), "state"), F.col("component") == F.col("c"), "left")
    bad = met.where(~F.col("state").eqNullSafe(F.col("expected")))
    return bad.groupBy("id").agg(F.count("*").alias("failures"))


def all_hold(required: DataFrame, states: DataFrame) -> DataFrame:
    """Ids of required (id, component, expected) whose every state holds at once."""
    met = required.join(states.select(F.col("component").alias("c"), "state"), F.col("component") == F.col("c"), "left")
    return met.groupBy("id").agg(F.bool_and(F.col("state").eqNullSafe(F.col("expected"))).alias("all")).where("all").select("id")


def intent_coverage(blocks: DataFrame, invariants: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, code): active blocks (id, lifecycle, purpose, summary, guarantees) without purpose and summary, guarantees without an invariant, and invariants (id, subject) of unknown subjects."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = blocks.where((F.col("lifecycle") == "active") & blank("purpose") & blank("summary")).select("id", F.lit("INTENT_MISSING").alias("code"))
    bare = blocks.where(F.size(F.coalesce("guarantees", F.array().cast("array<string>"))) > 0).join(invariants.select(F.col("id").alias("i")).distinct(), F.col("id") == F.col("i"), "left_anti").select("id", F.lit("INTENT_GUARANTEE_WITHOUT_INVARIANT").alias("code"))
    known = nodes.select(F.col("node").cast("string").alias("n")).distinct()
    unknown = invariants.where(~blank("subject") & (F.col("subject") != F.col("id").cast("string"))).join(known, F.col("subject") == F.col("n"), "left_anti").select("id", F.lit("INVARIANT_UNKNOWN_SUBJECT").alias("code"))
    return missing.unionByName(bare).unionByName(unknown)


def retry_risks(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, target, attempts, severity) of paths (arrays of nodes) on which nodes before a target that is not idempotent try more than once.

    nodes: (node, attempts, idempotent, non_idempotent, critical).
    """
    numbered = paths.where(F.size("path") > 1).distinct()
    steps = numbered.select("path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "step"))
    tries = steps.join(nodes.select(F.col("node").alias("n"), "attempts"), F.col("step") == F.col("n")).where("attempts > 1")
    product = F.aggregate(F.collect_list("attempts"), F.lit(1).cast("long"), lambda acc, x: acc * x.cast("long"))
    risky = tries.groupBy("path").agg(product.alias("attempts")).withColumn("target", F.element_at("path", -1))
    ends = nodes.where((F.col("idempotent") == F.lit(False)) | F.coalesce("non_idempotent", F.lit(False))).select(F.col("node").alias("t"), "critical")
    out = risky.join(ends, F.col("target") == F.col("t"))
    return out.select("path", "target", "attempts", F.when(F.coalesce("critical", F.lit(False)), "block").otherwise("warning").alias("severity"))


def layout_findings(includes: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(include, code) of listed shards: the first of no text, a pattern, outside the folder, no such file."""
    there = files.select(F.col("path").alias("p")).distinct()
    out = includes.join(there, F.col("include") == F.col("p"), "left")
    code = (
        F.when(F.col("include").isNull(), "INVALID_INCLUDE_TYPE").when(F.col("include").rlike(r"[*?]"), "GLOB_INCLUDE_NOT_ALLOWED")
        .when(~F.col("include").startswith(folder), "INCLUDE_OUTSIDE_BLOCKS_DIR").when(F.col("p").isNull(), "INCLUDE_FILE_MISSING")
    )
    return out.withColumn("code", code).where("code is not null").select("include", "code")


def artifact_findings(artifacts: DataFrame, files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, code, severity) of artifacts (id, path, profile, required, resolved): unknown profiles, missing files, and regions that are not found."""
    named = artifacts.where("profile is not null").join(profiles.select(F.col("profile").alias("k")).distinct(), F.col("profile") == F.col("k"), "left_anti")
    unknown = named.select("id", F.lit("UNKNOWN_ARTIFACT_PROFILE").alias("code"), F.lit("block").alias("severity"))
    met = artifacts.join(files.select(F.col("path").alias("p")).distinct(), F.col("path") == F.col("p"), "left")
    code = F.when(F.col("p").isNull(), "ARTIFACT_MISSING").when(~F.coalesce("resolved", F.lit(False)), "ARTIFACT_UNRESOLVED")
    severity = F.when(F.coalesce("required", F.lit(True)), "block").otherwise("warning")
    return unknown.unionByName(met.withColumn("code", code).where("code is not null").select("id", "code", severity.alias("severity")))


#: Names of filters over finding codes.
FILTERS = {
    "all": [], "undeclared": ["UNDECLARED_CODE"], "missing": ["MISSING_DECLARED_CODE"],
    "duplicate": ["DUPLICATE_ACTIVE_PROFILE", "DUPLICATE_PROFILE_REVIEW", "DUPLICATE_BLOCK_ID", "NORMALIZED_AST_CLONE", "SAME_RETURN_EXPRESSION", "TRIVIAL_WRAPPER", "SAME_OUTCOME", "SIMILAR_OUTCOME", "CONFLICTING_EFFECT"],
    "clone": ["NORMALIZED_AST_CLONE", "SAME_RETURN_EXPRESSION"], "wrapper": ["TRIVIAL_WRAPPER"],
    "effect": ["SAME_OUTCOME", "SIMILAR_OUTCOME", "CONFLICTING_EFFECT", "UNCLASSIFIED_EXTERNAL_EFFECT"], "outcome": ["SAME_OUTCOME", "SIMILAR_OUTCOME", "CONFLICTING_EFFECT"],
    "secret": ["SECRET_LIKE_VALUE"], "invalid": ["INVALID_STATUS", "INCOMPLETE_BLOCK", "INVALID_DOCUMENT"],
}


def filtered(findings: DataFrame, name: str) -> DataFrame:
    """Findings of a named filter; one without codes lets all pass."""
    return findings.where(F.col("code").isin(FILTERS[name])) if FILTERS[name] else findings


def report(findings: DataFrame, order: list[str], *, most: int, name: str = "all") -> DataFrame:
    """(code, n, shown): counts by code, and the first `most` messages of each, without a full sort of a code's findings."""
    rows = filtered(findings, name)
    top = rows.groupBy("code").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("_i") <= most)
    shown = ranked.groupBy(F.col("code").alias("c")).agg(F.array_sort(F.collect_list(F.struct("_i", "message"))).alias("m"))
    return top.join(shown, F.col("code") == F.col("c")).select("code", "n", F.transform("m", lambda x: x.message).alias("shown"))


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(issue, n): the sizes of all issue lists, zero included."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("issue"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
