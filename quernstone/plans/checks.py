"""Queries of sets that meet, records that lack fields, histories of entities and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import history, rules

from .registry import query, table

_LOCATED = ["domain", "status", "code.path", "code.symbol"]


@query("""
    WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority || o_orderstatus ORDER BY o_orderpriority || o_orderstatus) AS s, count(DISTINCT o_orderpriority || o_orderstatus) AS n FROM orders GROUP BY 1),
    t AS (SELECT DISTINCT list(DISTINCT o_orderpriority || o_orderstatus ORDER BY o_orderpriority || o_orderstatus) AS t FROM orders GROUP BY CAST(o_orderdate AS DATE))
    SELECT o_custkey AS grp, n FROM s WHERE s NOT IN (SELECT t FROM t)
""")
def sets_of_no_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose set of (priority, status) is that of no day."""
    orders = table(spark, sf_dir, "orders").withColumn("member", F.concat("o_orderpriority", "o_orderstatus"))
    groups, others = orders.select(F.col("o_custkey").alias("grp"), "member"), orders.select(F.to_date("o_orderdate").alias("grp"), "member")
    return rules.without_same_sets(groups, others, "grp", "member")


_PART_SQL = """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' Code ' WHEN 1 THEN NULL WHEN 2 THEN 'logical' ELSE '' END AS kind, CASE WHEN p_size % 10 <> 3 THEN p_partkey END AS id,
      CASE WHEN p_size % 5 <> 0 THEN p_type ELSE '' END AS domain, p_brand AS status, CASE WHEN p_partkey % 11 <> 0 AND p_size % 7 <> 0 THEN p_name END AS symbol, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS path
    FROM part
"""


@query(f"""
    WITH p AS ({_PART_SQL}), c AS (SELECT *, coalesce(nullif(lower(trim(kind)), ''), 'code') = 'code' AS code FROM p)
    SELECT p_partkey, concat_ws(',', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN code AND domain = '' THEN 'domain' END, CASE WHEN code AND status = '' THEN 'status' END,
      CASE WHEN code AND path IS NULL THEN 'code.path' END, CASE WHEN code AND symbol IS NULL THEN 'code.symbol' END) AS missing
    FROM c WHERE id IS NULL OR (code AND (domain = '' OR status = '' OR path IS NULL OR symbol IS NULL))
""")
def incomplete_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    code = F.when(F.col("p_partkey") % 11 != 0, F.struct(F.col("p_type").alias("path"), F.when(size % 7 != 0, F.col("p_name")).alias("symbol")))
    rows = p.select(
        "p_partkey", F.when(size % 4 == 0, " Code ").when(size % 4 == 2, "logical").when(size % 4 == 3, "").alias("kind"), F.when(size % 10 != 3, F.col("p_partkey")).alias("id"),
        F.when(size % 5 != 0, F.col("p_type")).otherwise("").alias("domain"), F.col("p_brand").alias("status"), code.alias("code"),
    )
    found = rules.incomplete_by_kind(rows, "kind", {"code": _LOCATED}, default="code", always=["id"])
    return found.select("p_partkey", F.array_join("missing", ",").alias("missing"))


@query("""
    SELECT o_orderkey AS operation, o_orderpriority AS reason, o_orderdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 7 ORDER BY o_orderkey DESC LIMIT 30
""")
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("operation"))
    return history.entity_history(deltas, _operations(spark, sf_dir), 7, uid="l_partkey", operation="operation", revision="operation")


@query("""
    SELECT l_partkey, o_orderkey AS operation, o_orderpriority AS reason, o_orderdate AS created_at, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderkey DESC) AS INTEGER) AS seq
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderkey DESC) <= 10
""")
def entity_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("operation"))
    return history.entity_histories(deltas, _operations(spark, sf_dir), uid="l_partkey", operation="operation", revision="operation", most=10)


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("operation"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("created_at"))


@query("""
    WITH r AS (SELECT lang AS kind, text FROM documents),
    k AS (SELECT coalesce(kind, 'None') AS name, count(*) AS n, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes FROM r GROUP BY 1)
    SELECT 'kind' AS section, name, n, n_bytes FROM k
    UNION ALL SELECT 'records', 'all', CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(sum(n_bytes), 0) AS BIGINT) FROM k
    UNION ALL SELECT 'changes', 'all', count(*), CAST(coalesce(sum(coalesce(strlen(CASE WHEN role <> 'user' THEN role END), 0) + coalesce(strlen(text), 0)), 0) AS BIGINT) FROM conversations
    UNION ALL SELECT 'operations', 'all', count(*), 0 FROM orders
    UNION ALL SELECT 'pending', 'all', count(*), 0 FROM events WHERE event_type = 'view'
""")
def metadata_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = table(spark, sf_dir, "conversations").select(F.when(F.col("role") != "user", F.col("role")).alias("before"), F.col("text").alias("after"))
    outbox = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("ts")).alias("published"))
    return history.size_report(table(spark, sf_dir, "documents"), "lang", "text", deltas, "before", "after", table(spark, sf_dir, "orders"), outbox, "published")
