"""Grouped set algebra, precedence, slots and shards over the fixture tables; units of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import grouping as g
from quernstone.sources import extract

from .registry import query, table

_KINDS = ["click", "view", "purchase"]


@query("""
    WITH d AS (SELECT DISTINCT c_nationkey AS grp, c_mktsegment AS unit, c_custkey % 4 AS member FROM customer),
    u AS (SELECT grp, count(DISTINCT unit) AS n FROM d GROUP BY 1), m AS (SELECT grp, member, count(*) AS k FROM d GROUP BY 1, 2)
    SELECT u.grp, coalesce(list(m.member ORDER BY m.member) FILTER (WHERE m.member IS NOT NULL), []) AS common FROM u LEFT JOIN m ON m.grp = u.grp AND m.k = u.n GROUP BY 1
""")
def common_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("unit"), (F.col("c_custkey") % 4).alias("member"))
    return g.common_members(rows, "grp", "unit", "member")


@query("SELECT l_suppkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS members FROM lineitem GROUP BY 1")
def united_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.all_members(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query("""
    WITH p AS (SELECT p_partkey AS k, p_brand AS b, CASE WHEN p_size > 10 THEN p_type END AS t FROM part)
    SELECT b, t, count(*) AS n, list(k ORDER BY k)[1:5] AS examples FROM p WHERE t IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3
""")
def profile_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("t"))
    return g.signatures(p, ["b", "t"], "k")


@query("SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 400")
def learned_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.top_counts(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber", 400)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_returnflag) = 1")
def same_return_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.one_value(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1")
def conflicting_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.several_values(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS INTEGER) AS rank FROM events")
def operation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.by_precedence(table(spark, sf_dir, "events"), "event_type", _KINDS).select("event_id", "rank")


@query("""
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 97 <> 0,
      CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, event_id) AS n FROM events) WHERE n = 1
""")
def primary_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = g.by_precedence(table(spark, sf_dir, "events"), "event_type", _KINDS)
    return g.choose(ranked, ["user_id"], F.col("event_id") % 97 == 0, F.col("rank"), "event_id")


@query("""
    WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS j FROM events WHERE event_type = 'click')
    SELECT user_id, event_id, value FROM events WHERE event_type <> 'click'
    UNION ALL SELECT a.user_id, a.event_id, b.value FROM s a JOIN s b ON a.user_id = b.user_id AND a.i = b.j
""")
def slots_refilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value").withColumn("v", F.col("value"))
    return g.refill_slots(events, F.col("event_type") == "click", "event_id", "v", "value", ["user_id"])


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'core' WHEN p_size < 20 THEN 'api' ELSE 'rest' END AS shard FROM part")
def shard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    path = F.concat_ws("/", F.when(size < 10, "src/core").when(size < 20, "src/api").otherwise("src/apix"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", g.shard_of(path, [("src/core", "core"), ("src/api", "api")], "rest").alias("shard"))


@query("""
    SELECT c_custkey, 'a/' || c_nationkey AS old_prefix, 'b/' || c_nationkey AS new_prefix FROM customer
    UNION ALL SELECT c_custkey, 'a', 'b' FROM customer
""")
def path_prefix_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda root: F.concat_ws("/", F.lit(root), F.col("c_nationkey").cast("string"), F.lit("x.py"))
    return g.prefix_moves(table(spark, sf_dir, "customer").select("c_custkey", path("a").alias("o"), path("b").alias("n")), "o", "n", "c_custkey")


@query("""
    SELECT c_nationkey FROM (SELECT c_nationkey, 'run' AS m, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || 'Strategy' ELSE c_mktsegment END AS p FROM customer)
    GROUP BY 1 HAVING count(DISTINCT m) = 1 AND count(DISTINCT p) >= 2 AND bool_and(p LIKE '%Strategy')
""")
def parallel_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_mktsegment", F.lit("Strategy"))).otherwise(F.col("c_mktsegment"))
    return g.parallel_strategies(table(spark, sf_dir, "customer").select("c_nationkey", F.lit("run").alias("m"), parent.alias("p")), "c_nationkey", "m", "p")


@query("SELECT DISTINCT l_suppkey AS target FROM lineitem WHERE l_partkey % 50 <> 0 AND l_suppkey % 50 = 0")
def referenced_by_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    ids = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"))
    return g.referenced_by_kept(edges, ids, "id")


@query()
def markup_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of all pages that the meaningful profile keeps."""
    return extract.units(table(spark, sf_dir, "pages"), "page_id", "html", lambda t: extract.html_units(t, meaningful=True))
