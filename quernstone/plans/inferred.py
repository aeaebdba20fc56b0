"""Queries of inferred relations, orders and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import inference as inf

from .registry import query, table

_BOXES = "b AS (SELECT s_suppkey AS id, 'm' || s_nationkey AS module, 'f' || s_suppkey % 9 AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN 'm' || s_nationkey || '.q' || s_suppkey END AS qualified_name FROM supplier)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    module = F.concat(F.lit("m"), "s_nationkey")
    return s.select(k.alias("id"), module.alias("module"), F.concat(F.lit("f"), k % 9).alias("symbol"), F.when(k % 2 == 0, F.concat(module, F.lit(".q"), k)).alias("qualified_name"))


@query(f"""
    WITH {_BOXES},
    c AS (SELECT DISTINCT module, name FROM (SELECT module, 'f' || (id + 1) % 9 AS name FROM b UNION ALL SELECT module, 'm' || (id % 25) || '.f' || id % 9 FROM b UNION ALL SELECT module, 'm' || id % 25 || '.q' || id FROM b)),
    l AS (SELECT module, symbol, max(id) AS id FROM b GROUP BY 1, 2),
    t AS (SELECT c.module, c.name, coalesce(q.id, l1.id, l2.id) AS target FROM c LEFT JOIN b q ON q.qualified_name = c.name
          LEFT JOIN l l1 ON NOT contains(c.name, '.') AND l1.module = c.module AND l1.symbol = c.name LEFT JOIN l l2 ON contains(c.name, '.') AND l2.module || '.' || l2.symbol = c.name),
    u AS (SELECT b.id AS source, t.target, 'uses' AS relationship, 'high' AS confidence, 'call:' || t.name AS evidence FROM b JOIN t ON t.module = b.module WHERE t.target IS NOT NULL AND t.target <> b.id
          UNION ALL SELECT b.id, o.id, 'depends_on', 'medium', 'import:' || o.module FROM b JOIN b o ON o.module = 'm' || (CAST(substr(b.module, 2) AS INTEGER) + 1) % 25 AND o.id <> b.id)
    SELECT source, target, relationship, max(confidence) AS confidence, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM u GROUP BY 1, 2, 3
""")
def inferred_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    names = [F.concat(F.lit("f"), (F.col("id") + 1) % 9), F.concat(F.lit("m"), F.col("id") % 25, F.lit(".f"), F.col("id") % 9), F.concat(F.lit("m"), F.col("id") % 25, F.lit(".q"), "id")]
    calls = b.select("module", F.explode(F.array(*names)).alias("name"))
    imports = b.select("module", F.concat(F.lit("m"), (F.substring("module", 2, 9).cast("int") + 1) % 25).alias("imported"))
    return inf.connections(b, calls, imports).withColumn("evidence", F.array_join("evidence", ","))


_UNITS = "u AS (SELECT DISTINCT 'p' || p_size % 5 AS path, CASE WHEN p_partkey % 3 = 0 THEN 'f' || p_size ELSE 'C' || p_partkey % 4 || '.f' || p_size END AS symbol FROM part)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    symbol = F.when(k % 3 == 0, F.concat(F.lit("f"), size)).otherwise(F.concat(F.lit("C"), k % 4, F.lit(".f"), size))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), size % 5).alias("path"), symbol.alias("symbol")).distinct()


@query(f"""
    WITH {_UNITS},
    c AS (SELECT path, symbol, n.ord, n.name, n.context FROM u, (SELECT 0 AS ord, 'f5' AS name, 'self' AS context UNION ALL SELECT 1, 'f7', NULL UNION ALL SELECT 2, 'f10', NULL UNION ALL SELECT 3, 'C1.f3', NULL) n),
    leaf AS (SELECT path, regexp_extract(symbol, '[^.]*$') AS l, min(symbol) AS s FROM u GROUP BY 1, 2 HAVING count(*) = 1),
    r AS (SELECT c.path, c.symbol, c.ord, coalesce(o.symbol, leaf.s, w.symbol) AS target FROM c
          LEFT JOIN u o ON c.context = 'self' AND contains(c.symbol, '.') AND o.path = c.path AND o.symbol = split_part(c.symbol, '.', 1) || '.' || c.name
          LEFT JOIN leaf ON leaf.path = c.path AND leaf.l = c.name LEFT JOIN u w ON w.path = c.path AND w.symbol = c.name)
    SELECT path, symbol, target, min(ord) AS ord FROM r WHERE target IS NOT NULL GROUP BY 1, 2, 3
""")
def resolved_internal_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    names = F.array(*map(F.lit, ["f5", "f7", "f10", "C1.f3"]))
    return inf.resolved_calls(u, u.select("path", "symbol", F.posexplode(names).alias("ord", "name")).withColumn("context", F.when(F.col("ord") == 0, "self")))


@query("""
    WITH n AS (SELECT DISTINCT 'p' || p_size % 5 AS path, p_brand AS symbol, 'r' || p_partkey % 11 AS root FROM part),
    a AS (SELECT 'p' || s_suppkey % 5 AS path, 'r' || s_suppkey % 7 AS local, arg_max('lib.' || s_suppkey, s_suppkey) AS full FROM supplier GROUP BY 1, 2)
    SELECT n.path, symbol, string_agg(DISTINCT "full", ',' ORDER BY "full") AS used FROM n JOIN a ON a.path = n.path AND a.local = n.root GROUP BY 1, 2
""")
def used_import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_size") % 5).alias("path"), F.col("p_brand").alias("symbol"), F.concat(F.lit("r"), F.col("p_partkey") % 11).alias("root"))
    k = F.col("s_suppkey")
    aliases = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), k % 5).alias("path"), k.alias("ord"), F.concat(F.lit("r"), k % 7).alias("local"), F.concat(F.lit("lib."), k).alias("full"))
    return inf.used_imports(names, aliases).withColumn("used", F.array_join("used", ","))


@query(f"""
    WITH {_UNITS}, w AS (SELECT DISTINCT 'p' || s_suppkey % 5 AS path, 'C' || s_suppkey % 4 AS owner, 'a' || s_suppkey % 3 AS attribute, 'x' || s_nationkey AS source FROM supplier)
    SELECT u.path, u.symbol, string_agg(DISTINCT w.attribute || '<-' || w.source, ',' ORDER BY w.attribute || '<-' || w.source) AS provenance
    FROM u JOIN w ON w.path = u.path AND contains(u.symbol, '.') AND w.owner = split_part(u.symbol, '.', 1) AND w.attribute IN ('a0', 'a2') GROUP BY 1, 2
""")
def attribute_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    writes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), k % 5).alias("path"), F.concat(F.lit("C"), k % 4).alias("owner"), F.concat(F.lit("a"), k % 3).alias("attribute"), F.concat(F.lit("x"), "s_nationkey").alias("source"))
    reads = _units(spark, sf_dir).select("path", "symbol", F.explode(F.array(F.lit("a0"), F.lit("a2"))).alias("attribute"))
    return inf.attribute_sources(reads, writes).withColumn("provenance", F.array_join("provenance", ","))


_EDGES = "e AS (SELECT DISTINCT o_custkey AS source, o_custkey // 3 AS target FROM orders WHERE o_custkey // 3 <> o_custkey)"


@query(f"""
    WITH RECURSIVE {_EDGES}, k AS (SELECT c_custkey AS node FROM customer),
    d AS (SELECT e.source, e.target FROM e JOIN k a ON a.node = e.source JOIN k b ON b.node = e.target),
    r AS (SELECT node, 0 AS level FROM k UNION SELECT d.source, r.level + 1 FROM d JOIN r ON r.node = d.target)
    SELECT node, max(level) AS level FROM r GROUP BY node
""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    units = c.select(F.col("c_custkey").alias("qualified_name"), F.lit(None).cast("long").alias("parent"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.floor(F.col("o_custkey") / 3).cast("long").alias("target"))
    return inf.dependency_levels(c.select(F.col("c_custkey").alias("node")), inf.dependencies(units, calls))


@query("SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def touched_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("path"))
    return inf.touched(artifacts, table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("path")))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_type = 'ECONOMY' AND (p_partkey % 4 = 1 OR p_size = 3) GROUP BY 1")
def nodes_by_kind_and_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array(F.concat(F.lit("r"), F.col("p_partkey") % 4), F.concat(F.lit("s"), F.col("p_size")))
    nodes = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_type").alias("kind"), lists.alias("artifacts"))
    economy = inf.by_kind(nodes, "ECONOMY")
    return inf.by_artifact(economy, "r1").union(inf.by_artifact(economy, "s3")).distinct().groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type || '-' || row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS identifier FROM events")
def numbered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.numbered_by_kind(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"]).select("event_id", "identifier")


@query("""
    WITH i AS (SELECT p_brand AS path, 'K' || p_size % 3 || CASE WHEN p_partkey % 2 = 0 THEN '.f' || p_size ELSE '' END AS symbol, min(p_partkey) AS start_line FROM part GROUP BY 1, 2),
    k AS (SELECT i.*, split_part(symbol, '.', 1) AS top, contains(symbol, '.') AS inner_one, coalesce(t.start_line, 0) AS top_line FROM i LEFT JOIN (SELECT path AS tp, symbol AS ts, start_line FROM i) t ON t.tp = i.path AND t.ts = split_part(i.symbol, '.', 1))
    SELECT path, symbol, CAST(row_number() OVER (PARTITION BY path ORDER BY top_line, top, CASE WHEN inner_one THEN 0 ELSE 1 END, start_line, symbol) AS INTEGER) AS place FROM k
""")
def hierarchical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    symbol = F.concat(F.lit("K"), size % 3, F.when(k % 2 == 0, F.concat(F.lit(".f"), size)).otherwise(""))
    issues = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path"), symbol.alias("symbol")).agg(F.min("p_partkey").alias("start_line"))
    return inf.review_order(issues.withColumn("start_line", F.col("start_line").cast("int"))).select("path", "symbol", "place")


@query("SELECT event_id, CASE WHEN event_id % 3 >= event_id % 2 THEN CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END ELSE CASE event_id % 2 WHEN 0 THEN 'low' ELSE 'medium' END END AS confidence FROM events")
def higher_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["low", "medium", "high"]))
    of = lambda n: F.get(names, (F.col("event_id") % n).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", inf.higher(of(3), of(2)).alias("confidence"))
