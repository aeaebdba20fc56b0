"""Plans of changes and their guards: requests, staleness, acceptance, regranulation, verified migration, child changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import canonical_json

from . import digest as tree
from .ordering import placed

#: Sources of requests that need no person if the evidence is mechanical, and parts of that evidence.
MECHANICAL_SOURCES = ["safe_mechanical_update", "controlled_refactor"]
EVIDENCE = {"exact_content_match": True, "one_to_one_match": True, "symbol_kind_matches": True, "purpose_preserved": True, "dangerous_capability_added": False}


def blocked_reason(requests: DataFrame, safe_kinds: list[str]) -> DataFrame:
    """requests (kind, source, human_confirmed, evidence struct) with `reason`: null where a request may go on."""
    e = F.col("evidence")
    match = e.isNotNull() & (e.competing_candidates == 0)
    for field, value in EVIDENCE.items():
        match = match & (e[field] == value)
    mechanical = F.col("source").isin(MECHANICAL_SOURCES) & F.col("kind").isin(safe_kinds)
    needs = F.when(mechanical & F.coalesce(match, F.lit(False)), None).when(mechanical, "The evidence does not name exactly one match.").otherwise("A person has to confirm this change.")
    return requests.withColumn("reason", F.when(~F.coalesce("human_confirmed", F.lit(False)), needs))


def mechanical_matches(lost: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, path, symbol) of lost units (id, kind, body_hash) that have exactly one candidate (id, path, symbol, kind, body_hash, dangerous), of equal body and kind and without a dangerous capability."""
    single = candidates.groupBy("id").agg(F.count("*").alias("n"), *[F.first(c).alias(f"c_{c}") for c in ("path", "symbol", "kind", "body_hash", "dangerous")]).where("n = 1")
    met = lost.join(single.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"))
    return met.where("body_hash is not null and body_hash = c_body_hash and kind = c_kind and not c_dangerous").select("id", F.col("c_path").alias("path"), F.col("c_symbol").alias("symbol"))


def operations(requests: DataFrame, kinds: DataFrame) -> DataFrame:
    """requests with the patch operation of their kind, from a table (kind, operation); `error` tells unknown kinds."""
    out = requests.join(F.broadcast(kinds.select(F.col("kind").alias("k"), "operation")), F.col("kind") == F.col("k"), "left").drop("k")
    return out.withColumn("error", F.when(F.col("operation").isNull(), F.concat(F.lit("unsupported change kind: "), "kind")))


def folded(records: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """records after a plan of steps (key, seq, operation, field, value): add, update, clear and delete, in order of seq.

    What holds at the end is the last delete or add of a record, then the last
    update of each field after it, so that nothing is folded row by row.
    """
    fields = [c for c in records.columns if c != key]
    life = steps.where("operation in ('add', 'delete')").groupBy(key).agg(F.max(F.struct("seq", "operation")).alias("life"))
    marks = steps.join(life.withColumnRenamed(key, "lk"), F.col(key) == F.col("lk"), "left")
    sets = marks.where("operation in ('update', 'clear') and seq > coalesce(life.seq, -1)")
    last = sets.groupBy(F.col(key).alias("sk"), "field").agg(F.max(F.struct("seq", "operation", "value")).alias("s"))
    wide = last.groupBy("sk").pivot("field", fields).agg(F.first("s"))
    every = records.select(key).union(life.where("life.operation = 'add'").select(key)).distinct()
    base = every.join(records.withColumnRenamed(key, "rk"), F.col(key) == F.col("rk"), "left").join(life.withColumnRenamed(key, "lk"), F.col(key) == F.col("lk"), "left").where("life is null or life.operation = 'add'")
    out = base.join(wide, F.col(key) == F.col("sk"), "left")

    def value(c: str) -> Column:
        old = F.when(F.col("life").isNull(), base[c])
        return F.when(wide[c].isNotNull(), F.when(wide[c]["operation"] == "update", wide[c]["value"].cast(records.schema[c].dataType))).otherwise(old).alias(c)

    return out.select(F.col(key), *[value(c) for c in fields])


def stale(actions: DataFrame, stamps: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """Actions whose file is not as it was when they were planned: another stamp, or gone, or new."""
    now = stamps.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in stamp])
    same = F.lit(True)
    for c in stamp:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return actions.join(now, F.col(key) == F.col("_k"), "left").where(~same).select(*actions.columns)


def regranulation(declared: DataFrame, current: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Declared rows that a change of granularity takes away: in the current units, not in the target's."""
    return declared.join(current.select(*keys).distinct(), keys, "left_semi").join(target.select(*keys).distinct(), keys, "left_anti")


def regranulation_refusals(removable: DataFrame, kept_references: DataFrame, purpose: Column) -> DataFrame:
    """One row: removable rows, those that kept rows refer to (target), and those with a purpose of their own."""
    referred = removable.join(kept_references.select(F.col("target").alias("t")).distinct(), F.col("id") == F.col("t"), "left_semi")
    return removable.agg(F.count("*").alias("n_removable"), F.count(F.when(purpose == "custom", 1)).alias("n_custom")).crossJoin(referred.agg(F.count("*").alias("n_referenced")))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def child_changes(before: DataFrame, after: DataFrame, parent: str, child: str, fields: list[str], kind: str) -> DataFrame:
    """(parent, child, event_type): bound, unbound and modified children of each parent."""
    a = before.select(F.col(parent).alias("pa"), F.col(child).alias("ca"), F.struct(*fields).alias("a"))
    b = after.select(F.col(parent).alias("pb"), F.col(child).alias("cb"), F.struct(*fields).alias("b"))
    both = a.join(b, (F.col("pa") == F.col("pb")) & (F.col("ca") == F.col("cb")), "full")
    what = F.when(F.col("pa").isNull(), "bound").when(F.col("pb").isNull(), "unbound").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.where(what.isNotNull()).select(F.coalesce("pa", "pb").alias(parent), F.coalesce("ca", "cb").alias(child), F.concat(F.lit(f"{kind}."), what).alias("event_type"))


def intent_digests(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """(id, digest) per block that has an intent or items (id, item as JSON): free of the order of items and of keys."""
    listed = items.groupBy(F.col("id").alias("iid")).agg(F.sort_array(F.collect_list(canonical_json(F.col("item")))).alias("items"))
    out = blocks.join(listed, F.col("id") == F.col("iid"), "left").where("intent is not null or items is not null")
    return out.select("id", F.sha2(F.concat_ws("\n", F.coalesce("purpose", F.lit("")), F.coalesce(canonical_json(F.col("intent")), F.lit("")), F.array_join("items", "\n")), 256).alias("digest"))


def intent_fingerprint(digests: DataFrame) -> DataFrame:
    """One row: the fingerprint of all blocks' intents, the root of a tree over their digests in order of id; null without any."""
    rows = placed(digests, [], ["id"], "place").select((F.col("place") - 1).alias("ordinal"), F.col("id").cast("string").alias("uid"), "digest")
    return tree.tree(rows).where(F.col("level") == tree.HEIGHT).agg(F.max("digest").alias("fingerprint"))


def accepted_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of digests (id, digest) that an acceptance changes: added, removed, changed."""
    b = after.select(F.col("id").alias("bid"), F.col("digest").alias("bd"))
    both = before.join(b, F.col("id") == F.col("bid"), "full")
    change = F.when(F.col("id").isNull(), "added").when(F.col("bid").isNull(), "removed").when(F.col("digest") != F.col("bd"), "changed")
    return both.where(change.isNotNull()).select(F.coalesce("id", "bid").alias("id"), change.alias("change"))


def stable_id(parts: list[Column]) -> Column:
    """Parts that are there, lower-case and trimmed, with single blanks as underscores, joined by colons."""
    return F.concat_ws(":", *[F.regexp_replace(F.lower(F.trim(p)), r"\s+", "_") for p in parts])


def evidence_digest(*fields: Column) -> Column:
    """Digest of the JSON of named fields, keys in order."""
    return F.sha2(canonical_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), 256)


def first_seen(rows: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """rows whose content no row before holds, by a partial aggregate."""
    first = rows.groupBy(F.col(digest).alias("fd")).agg(F.min(F.struct(*order)).alias("fo"))
    return rows.join(first, (F.col(digest) == F.col("fd")) & (F.struct(*order) == F.col("fo")), "left_semi")


def plan_state(plan: Column, before: Column, after: Column, found_before: Column, found_after: Column) -> Column:
    """stale where the input is not what was planned on, irreproducible where the result is not what was planned, else the plan."""
    return F.when(~before.eqNullSafe(found_before), "stale").when(~after.eqNullSafe(found_after), "irreproducible").otherwise(plan)
