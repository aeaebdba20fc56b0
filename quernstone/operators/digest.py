"""A digest of a document's records in their order, as a tree of bounded nodes that changes can be brought into.

A leaf covers the records of LEAF consecutive ordinals, a node FANOUT consecutive
nodes; HEIGHT levels reach any document, so that the root does not depend on how
much of it is filled. Which node a record belongs to follows from its ordinal
alone: the root is the same for any partitioning, and another for any reorder. All
groups are bounded, as ordinals are distinct. Leaves keep their records' digests, so
that a change reads and writes the nodes above it and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, FANOUT, HEIGHT = 256, 4096, 3
#: Leaves of a shelf, by which a stored table of leaves is partitioned.
SHELF = 4096
MEMBERS = "array<struct<ordinal:long,uid:string,digest:string>>"


def _part(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def record_digest(uid: Column, fields: Column) -> Column:
    """The digest of one record: of its uid and its fields in order of their names, each name and value with its length in bytes."""
    entries = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(_part(e["key"]), _part(e["value"])))
    return F.sha2(F.concat(_part(uid), F.coalesce(F.array_join(entries, ""), F.lit(""))), 256)


def leaves(rows: DataFrame) -> DataFrame:
    """Leaves (idx, members, digest) of rows (ordinal, uid, digest)."""
    member = F.struct(F.col("ordinal").cast("long").alias("ordinal"), "uid", "digest")
    grouped = rows.groupBy(F.expr(f"ordinal div {LEAF}").alias("idx")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return grouped.withColumn("digest", leaf_digest(F.col("members")))


def leaf_digest(members: Column) -> Column:
    return F.sha2(F.array_join(F.transform(members, lambda m: F.concat(m["ordinal"].cast("string"), F.lit(":"), m["digest"])), ","), 256)


def above(nodes: DataFrame) -> DataFrame:
    """The nodes (idx, digest) over nodes (idx, digest) of the level below."""
    child = F.struct("idx", "digest")
    grouped = nodes.groupBy(F.expr(f"idx div {FANOUT}").alias("parent")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    return grouped.select(F.col("parent").alias("idx"), F.sha2(F.array_join(F.transform("c", lambda c: F.concat(c["idx"].cast("string"), F.lit(":"), c["digest"])), ","), 256).alias("digest"))


def tree(rows: DataFrame) -> DataFrame:
    """All nodes (level, idx, digest) of rows (ordinal, uid, digest)."""
    level = leaves(rows).select("idx", "digest")
    out = level.select(F.lit(0).alias("level"), "idx", "digest")
    for n in range(1, HEIGHT + 1):
        level = above(level)
        out = out.unionByName(level.select(F.lit(n).alias("level"), "idx", "digest"))
    return out


def root(nodes: DataFrame) -> str | None:
    """The root's digest; null for a document without records."""
    r = nodes.where(F.col("level") == HEIGHT).select("digest").first()
    return r.digest if r else None


def changed_leaves(old: DataFrame, changes: DataFrame) -> DataFrame:
    """What becomes of the leaves that changes touch; an emptied leaf has no digest.

    old: leaves (idx, members), of which the touched ones are read. changes: (uid,
    was, ordinal, digest), `was` the ordinal that a record had, null if it is new,
    ordinal null if it goes.
    """
    at = lambda c: F.expr(f"{c} div {LEAF}").alias("idx")
    touched = changes.where("was is not null").select(at("was")).unionByName(changes.where("ordinal is not null").select(at("ordinal"))).distinct()
    kept = old.join(touched, "idx", "left_semi").select(F.explode("members").alias("m")).select("m.*").join(changes.select("uid"), "uid", "left_anti")
    new = leaves(kept.select("ordinal", "uid", "digest").unionByName(changes.where("ordinal is not null").select("ordinal", "uid", "digest")))
    return touched.join(new, "idx", "left").select("idx", F.coalesce("members", F.array().cast(MEMBERS)).alias("members"), "digest")


def changed_above(old: DataFrame, changed: DataFrame) -> DataFrame:
    """What becomes of the nodes over changed ones (idx, digest); old: all nodes of the changed ones' level, as they were."""
    parent = F.expr(f"idx div {FANOUT}")
    touched = changed.select(parent.alias("parent")).distinct()
    kept = old.join(touched, parent == F.col("parent"), "left_semi").join(changed.select("idx"), "idx", "left_anti").select("idx", "digest")
    new = above(kept.unionByName(changed.where("digest is not null").select("idx", "digest")))
    return touched.select(F.col("parent").alias("idx")).join(new, "idx", "left").select("idx", "digest")


def update(old: Callable[[int], DataFrame], old_leaves: DataFrame, changes: DataFrame, write: Callable[[DataFrame, int], DataFrame]) -> str | None:
    """Bring changes into a stored tree and return the new root.

    old(level) gives the nodes (idx, digest) of a level as they were; write(nodes,
    level) stores the changed nodes of a level and gives them back.
    """
    changed = write(changed_leaves(old_leaves, changes), 0)
    for level in range(HEIGHT):
        changed = write(changed_above(old(level), changed), level + 1)
    r = changed.first()
    return r.digest if r else old(HEIGHT).select("digest").first().digest
