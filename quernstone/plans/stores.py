"""Queries of the versioned store and of the digest of a document in its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import digest as tree
from quernstone.operators.publish import work_folder
from quernstone.operators.store import Store

from .registry import query, table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as records of a document, in order of p_partkey."""
    fields = F.map_concat(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name")), F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part "), "p_partkey").alias("uid"), F.col("p_partkey").cast("long").alias("ordinal"), fields.alias("fields"))


def _bytes_sql(c: str) -> str:
    return f"strlen({c}) || ':' || {c}"


def _record_sql(uid: str, brand: str, name: str, size: str) -> str:
    fields = " || ".join(f"'{len(k)}:{k}' || {_bytes_sql(v)}" for k, v in (("brand", brand), ("name", name), ("size", size)))
    return f"sha256({_bytes_sql(uid)} || {fields})"


def tree_sql(records: str) -> str:
    """All nodes over records (ordinal, digest)."""
    levels = [f"n0 AS (SELECT 0 AS level, ordinal // {tree.LEAF} AS idx, sha256(string_agg(ordinal || ':' || digest, ',' ORDER BY ordinal)) AS digest FROM {records} GROUP BY ordinal // {tree.LEAF})"]
    levels += [f"n{k} AS (SELECT {k} AS level, idx // {tree.FANOUT} AS idx, sha256(string_agg(idx || ':' || digest, ',' ORDER BY idx)) AS digest FROM n{k - 1} GROUP BY idx // {tree.FANOUT})" for k in range(1, tree.HEIGHT + 1)]
    return ",\n".join(levels)


_EVERY_NODE = " UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(tree.HEIGHT + 1))


@query(f"""
    WITH r AS (SELECT o_orderkey AS ordinal, sha256({_bytes_sql("'order ' || o_orderkey")} || '6:status' || {_bytes_sql("o_orderstatus")}) AS digest FROM orders),
    {tree_sql("r")}
    {_EVERY_NODE}
""")
def document_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid, fields = F.concat(F.lit("order "), "o_orderkey"), F.create_map(F.lit("status"), F.col("o_orderstatus"))
    return tree.tree(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), uid.alias("uid"), tree.record_digest(uid, fields).alias("digest")))


def _edited(spark: SparkSession, sf_dir: str) -> Store:
    """A store of part after two patches, whose edits come from the lines of two suppliers, and a replacement without the parts of size 9."""
    store = Store(spark, f"{work_folder(spark)}/store", buckets=4)
    store.import_records(_parts(spark, sf_dir), actor="query")
    edit = lambda seq, op, field, value: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(field).alias("field"), value.cast("string").alias("value"))
    sold = table(spark, sf_dir, "lineitem").where("l_suppkey = 1").groupBy("l_partkey").agg(F.sum("l_linenumber").alias("n"))
    edits = sold.select(F.concat(F.lit("part "), "l_partkey").alias("uid"), F.explode(F.array(edit(1, "set", "size", F.lit("0")), edit(2, "set", "size", F.col("n")))).alias("e")).select("uid", "e.*")
    store.apply_patches(edits, actor="query", reason="lines of a supplier", expected=1)
    other = table(spark, sf_dir, "lineitem").where("l_suppkey = 2").select("l_partkey").distinct()
    renames = other.select(F.concat(F.lit("part "), "l_partkey").alias("uid"), edit(1, "set", "brand", F.lit("Brand#1")).alias("e")).select("uid", "e.*")
    store.apply_patches(renames, actor="query", reason="lines of another", expected=2)
    kept = store.read().where("fields['size'] <> '9'").select("uid", "ordinal", "fields")
    store.replace(kept, actor="query", reason="without a size", expected=3)
    return store


_STORE_SQL = """
    s AS (SELECT l_partkey AS k, sum(l_linenumber) AS n FROM lineitem WHERE l_suppkey = 1 GROUP BY 1),
    t AS (SELECT DISTINCT l_partkey AS k2 FROM lineitem WHERE l_suppkey = 2),
    c AS (SELECT p_partkey, 'part ' || p_partkey AS uid, p_name AS name, coalesce(n, p_size)::VARCHAR AS size, CASE WHEN k2 IS NOT NULL THEN 'Brand#1' ELSE p_brand END AS brand,
            CASE WHEN k2 IS NOT NULL AND p_brand <> 'Brand#1' THEN 3 WHEN n <> p_size THEN 2 ELSE 1 END AS revision,
            p_brand, p_size::VARCHAR AS p_size, n IS NOT NULL AND n <> p_size AS resized, k2 IS NOT NULL AND p_brand <> 'Brand#1' AS renamed
          FROM part LEFT JOIN s ON k = p_partkey LEFT JOIN t ON k2 = p_partkey)
"""


@query(f"WITH {_STORE_SQL} SELECT uid, p_partkey::BIGINT AS ordinal, revision::BIGINT AS revision, brand, name, size FROM c WHERE size <> '9'")
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).read().select("uid", "ordinal", "revision", *[F.col("fields")[k].alias(k) for k in ("brand", "name", "size")])


@query(f"WITH {_STORE_SQL} SELECT uid, p_brand AS brand, size FROM c")
def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of revision 2, as a later base leaves them."""
    store = _edited(spark, sf_dir)
    store.compact()
    return store.read(2).select("uid", *[F.col("fields")[k].alias(k) for k in ("brand", "size")])


@query(f"""
    WITH {_STORE_SQL}
    SELECT 1 AS operation, 'record.upsert' AS kind, uid, NULL AS size_before, p_size AS size_after FROM c
    UNION ALL SELECT 2, 'record.patch', uid, p_size, size FROM c WHERE resized
    UNION ALL SELECT 3, 'record.patch', uid, size, size FROM c WHERE renamed
    UNION ALL SELECT 4, 'record.delete', uid, size, NULL FROM c WHERE size = '9'
""")
def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _edited(spark, sf_dir).log()
    return log.select(F.col("operation").cast("int").alias("operation"), "kind", "uid", F.col("before")["size"].alias("size_before"), F.col("after")["size"].alias("size_after"))


@query(f"""
    WITH {_STORE_SQL},
    r AS (SELECT p_partkey AS ordinal, {_record_sql("uid", "brand", "name", "size")} AS digest FROM c WHERE size <> '9'),
    {tree_sql("r")}
    SELECT digest FROM n{tree.HEIGHT}
""")
def store_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that three changes have brought along, in the row of its node."""
    store = _edited(spark, sf_dir)
    nodes = store._nodes(store.state())
    return nodes.where((F.col("level") == tree.HEIGHT) & (F.col("digest") == store.digest())).select("digest")
