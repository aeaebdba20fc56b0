"""Change history: event typing, ledger queries, freshness, fingerprints, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import canonical_json, digest

#: Event types by which changed fields decide, most telling first, for direct capture and for the outbox.
CAPTURE_ORDER = [("intent", "intent.changed"), ("invariants", "invariants.changed"), ("artifacts", "artifacts.changed"), ("connections", "flow.changed"), ("id", "block.renamed")]
OUTBOX_ORDER = [("id", "block.renamed"), ("intent", "intent.changed"), ("code", "artifacts.changed"), ("connections", "flow.changed"), ("invariants", "invariants.changed")]
OTHER = "metadata.changed"


def event_type(existed: Column, exists: Column, changed: Column, order: list[tuple[str, str]]) -> Column:
    """Type of a change: created, removed, or that of the first telling field among the changed ones."""
    out = F.when(~existed, "block.created").when(~exists, "block.removed")
    for field, name in order:
        out = out.when(F.array_contains(changed, field), name)
    return out.when(F.size(changed) > 0, OTHER)


def capture(before: DataFrame, after: DataFrame, key: str, fields: list[str], order: list[tuple[str, str]] = CAPTURE_ORDER) -> DataFrame:
    """One event per key that differs between two versions: event_type and changed_fields."""
    a = before.select(key, F.struct(*fields).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(key, F.struct(*fields).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full_outer").withColumn("_in_a", F.coalesce("_in_a", F.lit(False))).withColumn("_in_b", F.coalesce("_in_b", F.lit(False)))
    changed = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields])))
    return both.select(key, event_type(F.col("_in_a"), F.col("_in_b"), changed, order).alias("event_type"), F.array_join(changed, ",").alias("changed_fields")).where("event_type is not null")


def consecutive(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Events whose value differs from the one before of the same key; the first of a key is a baseline."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = events.withColumn("previous", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    drift = F.when(F.col("_n") == 1, "baseline").when(~F.col(value).eqNullSafe(F.col("previous")), "content_drift")
    return out.withColumn("drift", drift).where("drift is not null").drop("_n")


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Last state per key, by a partial aggregate and no sort."""
    row = F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])
    return events.groupBy(*keys).agg(F.max(row).alias("_m")).select(*keys, *[F.col(f"_m._{c}").alias(c) for c in columns])


def trusted_latest(journal: DataFrame, key: str, line: str, corrupt: str, columns: list[str]) -> DataFrame:
    """Latest valid line per key with `state`: corrupt if a broken line follows it."""
    broken = journal.agg(F.max(F.when(F.col(corrupt), F.col(line))).alias("_broken"))
    good = latest(journal.where(~F.col(corrupt)), [key], [line], [line, *columns])
    return good.crossJoin(F.broadcast(broken)).withColumn("state", F.when(F.col("_broken") > F.col(line), "corrupt").otherwise("ok")).drop("_broken")


def ledger(events: DataFrame, target: str, identity: list[str], *, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Events that name target in any identity column, newest first."""
    hit = events.where(F.array_contains(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), target))
    hit = hit if types is None else hit.where(F.col("event_type").isin(types))
    hit = hit.orderBy(F.desc("ts"), F.desc("event_id"))
    return hit if limit is None else hit.limit(limit)


def entity_history(deltas: DataFrame, log: DataFrame, entity: str, *, uid: str, operation: str, revision: str, most: int = 30) -> DataFrame:
    """The operations that changed one entity, newest first: the columns of log, once for each of its deltas."""
    hit = deltas.where(F.col(uid) == entity).select(operation)
    return hit.join(log, operation).orderBy(F.desc(revision), operation).limit(most)


def entity_histories(deltas: DataFrame, log: DataFrame, *, uid: str, operation: str, revision: str, most: int = 30) -> DataFrame:
    """As entity_history for every entity of deltas, with its uid and seq, the place from 1.

    The ranks are cut by partition before the rows of a hot entity meet.
    """
    met = deltas.select(uid, operation).join(log, operation)
    return met.withColumn("seq", F.row_number().over(Window.partitionBy(uid).orderBy(F.desc(revision), operation))).where(F.col("seq") <= most)


def search(events: DataFrame, text: str, column: str, limit: int | None = None) -> DataFrame:
    """Payload search in which % and _ of the text keep their wildcard meaning."""
    hit = events.where(F.col(column).ilike(f"%{text}%")).orderBy(F.desc("ts"), F.desc("event_id"))
    return hit if limit is None else hit.limit(limit)


def why(events: DataFrame, preferred: list[str], reason: str, limit: int = 20) -> DataFrame:
    """Preferred events with a reason, or if there are none, the newest with any reason."""
    given = events.where(F.length(F.col(reason)) > 0)
    best = given.where(F.col("event_type").isin(preferred))
    pick = given if best.isEmpty() else best
    return pick.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def _of_each(rows: DataFrame, key: str, order: list[str], pick) -> DataFrame:
    """One row per key, the first or last in order, by a partial aggregate."""
    rest = [c for c in rows.columns if c != key]
    got = rows.groupBy(key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def last_wins(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Index rebuild: the last row of each id stands."""
    return _of_each(events, key, order, F.max_by)


def first_wins(objects: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Content-addressed objects: the first row of each digest stands."""
    return _of_each(objects, key, order, F.min_by)


def content_objects(values: DataFrame, column: str) -> DataFrame:
    """(digest, content) of distinct canonical values."""
    text = F.coalesce(canonical_json(F.col(column)), F.col(column))
    return values.where(F.col(column).isNotNull()).select(digest(text).alias("digest"), text.alias("content")).dropDuplicates(["digest"])


def prunable(operations: DataFrame, keep: int, revision: str, pending: DataFrame, key: str) -> DataFrame:
    """Operations beyond the newest `keep`, but for pending ones. The kept ones are found by a bounded top-k."""
    kept = operations.select(key, revision).orderBy(F.desc(revision), F.desc(key)).limit(keep).select(key)
    return operations.join(kept, key, "left_anti").join(pending.select(key).distinct(), key, "left_anti")


def sizes(deltas: DataFrame, before: str, after: str) -> DataFrame:
    """Rows and bytes of deltas; a side that is null throughout makes the bytes 0."""
    total = F.sum(F.octet_length(before)) + F.sum(F.octet_length(after))
    return deltas.agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).cast("long").alias("n_bytes"))


def size_report(records: DataFrame, kind: str, raw: str, deltas: DataFrame, before: str, after: str, operations: DataFrame, outbox: DataFrame, published: str) -> DataFrame:
    """(section, name, n, n_bytes) of a catalogue: its records in all and by kind, changes, operations, and events that wait.

    Bytes are those of the texts in UTF-8, 0 where a section has none; a null kind
    is called None. Empty tables give zeros, and no kinds.
    """
    size = lambda *c: F.coalesce(F.sum(sum((F.coalesce(F.octet_length(x), F.lit(0)) for x in c[1:]), F.coalesce(F.octet_length(c[0]), F.lit(0)))), F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    row = lambda section, name, n, n_bytes: [F.lit(section).alias("section"), name.alias("name"), n.alias("n"), n_bytes.alias("n_bytes")]
    kinds = records.groupBy(F.coalesce(F.col(kind).cast("string"), F.lit("None")).alias("name")).agg(F.count("*").alias("n"), size(raw).alias("n_bytes"))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
    changes = deltas.agg(F.count("*").alias("n"), size(before, after).alias("n_bytes"))
    every = F.lit("all")
    out = kinds.select(*row("kind", F.col("name"), F.col("n"), F.col("n_bytes"))).unionByName(total.select(*row("records", every, F.col("n"), F.col("n_bytes"))))
    out = out.unionByName(changes.select(*row("changes", every, F.col("n"), F.col("n_bytes"))))
    out = out.unionByName(operations.agg(F.count("*").alias("n")).select(*row("operations", every, F.col("n"), none)))
    return out.unionByName(outbox.where(F.col(published).isNull()).agg(F.count("*").alias("n")).select(*row("pending", every, F.col("n"), none)))


def freshness(required: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """State of each required key: missing, stale (not passed, or for another fingerprint) or fresh."""
    e = evidence.select(F.col(key).alias("_k"), F.col("status").alias("_s"), F.col("fingerprint").alias("_f"))
    state = F.when(F.col("_k").isNull(), "missing").when((F.col("_s") != "pass") | ~F.col("_f").eqNullSafe(F.col("fingerprint")), "stale").otherwise("fresh")
    return required.join(e, F.col(key) == F.col("_k"), "left").select(key, state.alias("state"))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Digest per key over its rows, whatever their order."""
    row = F.to_json(F.struct(*columns))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("fingerprint"))


def reusable(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the decision taken on the same stable id and evidence."""
    return items.join(decisions.select("stable_id", "evidence_hash", "decision"), ["stable_id", "evidence_hash"])


def without_owner(events: DataFrame, closure: str, owner: str) -> DataFrame:
    return events.withColumn(closure, F.array_remove(F.col(closure), F.col(owner)))
