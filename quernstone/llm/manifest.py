"""Merkle manifest of a table, with a proof for each row.

A row's digest (leaf) covers its fields; every FANOUT consecutive nodes of a source
become one, level by level, down to one subroot a source, and the subroots likewise
become the root. A level is one window: partitioned by source and parent index, its
ordered full-frame collect_list holds the digests of a whole run, which are both the
parent's input and each member's siblings; the first member of a run then stands for
the parent on the next level. Windows hold FANOUT rows at most, whatever the size of
a source, and positions within a source come from a range sort and from counts per
partition, so that a source with a third of all rows needs no task of its own.

Paths come back from the root: the nodes of a level join their parents' paths, of
which there are a third as many. Digests travel as 32 bytes and are hashed as hex.

Null fields are written as "-". A null source is a source of its own, before all
others; null doc_ids come first in their source. Rows that share a doc_id are
ordered by leaf, and repeated rows take neighbouring places, of which it does not
matter which is whose. Empty and very long texts are hashed whole. An empty table
gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Children of a node.
FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """A row's digest: lowercase hex of its fields, each with its length, or "-" if null."""
    return F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256)


def _node(children: Column) -> Column:
    """The digest, as 32 bytes, of children's digests one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(children)).cast("binary"), 256))


def placed(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """df, a stored table with a column grp, and beside it idx, a row's place in its group from 0, and n, the group's rows.

    Rows are sorted over the cluster by group and order; a row's number within its
    partition, less that of the group's first row there, plus the group's rows in
    earlier partitions, is its place. Equal rows are spread by their row number.
    """
    spread = df.withColumn("tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("grp", *order, "tie").sortWithinPartitions("grp", *order, "tie").drop("tie")
    ranged = scratch.table(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    counts = ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    over = Window.partitionBy("grp")
    earlier = F.sum("rows").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(over).alias("n"))
    out = ranged.join(counts, (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p")))
    return out.withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift", "g", "p")


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda acc, x: F.concat(acc, x))


def _step(run: str, idx: str) -> Column:
    """A member's siblings in its run: those before it and those after it, 32 bytes each."""
    own = F.pmod(F.col(idx), F.lit(FANOUT)).cast("int") * 32
    return F.struct(F.substr(F.col(run), F.lit(1), own).alias("before"), F.substr(F.col(run), own + 33).alias("after"))


def climb(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees over nodes (grp, idx, n, digest, ...), and what remains of each group (grp, digest, level).

    A level holds the nodes of groups that have several there, each with its run's digests.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = nodes.where("n = 1").select("grp", "digest", F.lit(0).alias("level"))
    frame = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while most > 1:
        level = nodes.where("n > 1").withColumn("parent", F.expr(f"idx div {FANOUT}")).withColumn("run", _joined(F.collect_list("digest").over(frame)))
        level = scratch.table(level.drop("parent") if not levels else level.drop("parent", "digest"), f"{name}-level{len(levels)}")
        levels.append(level)
        # one row a run, its first, stands for the parent
        first = level.where(F.pmod("idx", F.lit(FANOUT)) == 0)
        nodes = first.select("grp", F.expr(f"idx div {FANOUT}").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), _node(F.col("run")).alias("digest"))
        tops = tops.unionByName(nodes.where("n = 1").select("grp", "digest", F.lit(len(levels)).alias("level")))
        most = -(-most // FANOUT)
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of the lowest level with keep (columns of tops) and steps, the siblings from the row to the top.

    tops: (grp, level, steps, ...) of each group, with the steps from its top upward.
    Groups of a single node have no row here.
    """
    paths = None
    for at in range(len(levels) - 1, -1, -1):
        over = tops.where(F.col("level") == at + 1).select(F.col("grp").alias("g"), F.lit(0).cast("long").alias("i"), "steps", *keep)
        over = over if paths is None else over.unionByName(paths.select(F.col("grp").alias("g"), F.col("idx").alias("i"), "steps", *keep))
        level = levels[at].join(over, (F.col("grp") == F.col("g")) & (F.expr(f"idx div {FANOUT}") == F.col("i")))
        paths = level.withColumn("steps", F.concat(F.array(_step("run", "idx")), "steps")).drop("g", "i", "run")
    return paths


def folded(leaf: Column, steps: Column) -> Column:
    """The top's digest that a leaf (hex) and its steps give."""
    hexed = lambda b: F.lower(F.hex(b))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(hexed(s["before"]), acc, hexed(s["after"])).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings' digests, from the leaf's run to the root's, left to right."""
    siblings = F.aggregate(steps, F.lit(b""), lambda acc, s: F.concat(acc, s["before"], s["after"]))
    return F.sha2(F.lower(F.hex(siblings)).cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, leaf_now) of every row; steps hold the siblings, leaf_now the digest with the text that tampered gives."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    fields = [F.col(c) for c in FIELDS]
    now = F.lit(None).cast("string") if tampered is None else F.when(~tampered.eqNullSafe(F.col("text")), leaf_digest([*fields[:-1], tampered]))
    # a group's key sorts as its source does, null first
    grp = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    leaves = scratch.table(docs.select("doc_id", grp.alias("grp"), F.unhex(leaf_digest(fields)).alias("digest"), F.unhex(now).alias("now")), "leaves")

    nodes = scratch.table(placed(leaves, ["doc_id", "digest"], scratch, "leaves"), "placed")
    scratch.drop("leaves", "leaves-sorted")
    levels, tops = climb(nodes, scratch, "doc")
    tops = scratch.table(tops, "subroots")

    # the subroots, as one group; its top has no step above it
    high = placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest", "level"), ["of"], scratch, "subroots")
    high = scratch.table(high, "subroots-placed")
    above, root = climb(high, scratch, "top")
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    paths = descend(above, root.withColumnRenamed("digest", "root").withColumn("steps", none), ["root"]) if above else high.withColumn("root", F.col("digest")).withColumn("steps", none)
    paths = scratch.table(paths.select(F.col("of").alias("grp"), "level", F.col("digest").alias("subroot"), "root", "steps"), "paths")

    alone = nodes.where("n = 1").join(paths.select(F.col("grp").alias("g"), "subroot", "root", "steps"), F.col("grp") == F.col("g"))
    cols = ["doc_id", "digest", "now", "subroot", "root", "steps"]
    out = alone.select(*cols)
    if levels:
        out = out.unionByName(descend(levels, paths, ["subroot", "root"]).select(*cols))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", hexed("digest").alias("leaf"), hexed("subroot"), hexed("root"), "steps", F.coalesce(F.lower(F.hex("now")), F.lower(F.hex("digest"))).alias("leaf_now"))


def verified_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Of every row its leaf, subroot, root and proof, and whether the text that tampered gives still folds to the root."""
    out = manifest(docs, tampered).withColumn("folded_root", folded(F.col("leaf_now"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
