"""Graph queries over a small graph made from nations: 25 nodes, two edges from each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import graph

from .registry import query, table

_EDGES_SQL = """
    e AS (SELECT n_nationkey AS source, (n_nationkey * 2 + 1) % 25 AS target FROM nation WHERE n_nationkey % 4 <> 3
          UNION ALL SELECT n_nationkey, (n_nationkey * 3) % 25 FROM nation WHERE n_nationkey % 3 = 1),
    nodes AS (SELECT n_nationkey AS id, n_regionkey = 3 AS critical, CAST(n_nationkey * 10 % 70 AS DOUBLE) AS load, CAST(40 + n_nationkey * 13 % 60 AS DOUBLE) AS capacity FROM nation)
"""
_REACH_SQL = """
    r(origin, node, depth) AS (
      SELECT source, target, 1 FROM e
      UNION SELECT r.origin, e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node WHERE r.depth < 25)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    a = n.where(k % 4 != 3).select(k.alias("source"), ((k * 2 + 1) % 25).alias("target"))
    return a.union(n.where(k % 3 == 1).select(k, (k * 3) % 25))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("id"), (F.col("n_regionkey") == 3).alias("critical"), (k * 10 % 70).cast("double").alias("load"), (k * 13 % 60 + 40).cast("double").alias("capacity"))


@query(f"WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL} SELECT DISTINCT origin, node FROM r WHERE origin < 5 AND origin <> node")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(edges(spark, sf_dir), nodes(spark, sf_dir).where("id < 5")).select("origin", "node")


@query(f"WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL} SELECT node AS origin, origin AS node, min(depth) AS depth FROM r WHERE node = 7 AND origin <> 7 GROUP BY 1, 2 HAVING min(depth) <= 2")
def graph_reverse_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(graph.reverse(edges(spark, sf_dir)), nodes(spark, sf_dir).where("id = 7"), max_depth=2)


@query(f"WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL} SELECT origin, node, min(depth) AS length FROM r WHERE origin IN (1, 2) AND node <> origin GROUP BY 1, 2")
def shortest_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = edges(spark, sf_dir).withColumn("ord", F.col("source") * 100 + F.col("target"))
    found = graph.shortest_paths(steps, nodes(spark, sf_dir).where("id in (1, 2)"))
    return found.select("origin", "node", (F.size("path") - 1).alias("length"))


@query(f"""WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL}
    SELECT a.id AS source, b.id AS target, a.id = b.id OR EXISTS (SELECT 1 FROM r WHERE r.origin = a.id AND r.node = b.id) AS "exists" FROM nodes a, nodes b WHERE a.id < 4""")
def path_exists_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    pairs = n.where("id < 4").select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("target"))
    return graph.path_exists(edges(spark, sf_dir), pairs)


@query(f"""WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL}, c(id) AS (VALUES (3), (8)),
    m AS (SELECT node AS id, depth FROM r WHERE origin IN (SELECT id FROM c) UNION ALL SELECT origin, depth FROM r WHERE node IN (SELECT id FROM c))
    SELECT id, 'changed' AS reach FROM c UNION ALL SELECT id, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END FROM m WHERE id NOT IN (SELECT id FROM c) GROUP BY id""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.impact(edges(spark, sf_dir), n.where("id in (3, 8)"), n).select("id", "reach")


@query(f"""WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL}, c(id) AS (VALUES (3), (8)),
    m AS (SELECT node AS id FROM r WHERE origin IN (SELECT id FROM c) UNION SELECT origin FROM r WHERE node IN (SELECT id FROM c)),
    x AS (SELECT count(*) AS n, coalesce(bool_or(critical), FALSE) AS c FROM m JOIN nodes USING (id) WHERE id NOT IN (SELECT id FROM c))
    SELECT n, c OR n >= 12 AS systemic FROM x""")
def systemic_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.is_systemic(graph.impact(edges(spark, sf_dir), n.where("id in (3, 8)"), n), n.count())


@query(f"""WITH RECURSIVE {_EDGES_SQL}, u AS (SELECT source, target FROM e WHERE source < 12 UNION SELECT target, source FROM e WHERE source < 12),
    c(node, other) AS (SELECT source, source FROM u UNION SELECT c.node, u.target FROM c JOIN u ON u.source = c.other)
    SELECT node, min(other) AS component FROM c GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir).where("source < 12"))


_DAG_SQL = "d AS (SELECT source, target FROM e WHERE source < target)"
_PATHS_SQL = """
    p(path, tip) AS (
      SELECT [source], source FROM (SELECT DISTINCT source FROM d WHERE source NOT IN (SELECT target FROM d))
      UNION ALL SELECT list_append(p.path, x.target), x.target FROM p JOIN (SELECT DISTINCT source, target FROM d) x ON x.source = p.tip)
"""


@query(f"WITH RECURSIVE {_EDGES_SQL}, {_DAG_SQL}, {_PATHS_SQL} SELECT array_to_string(path, '>') AS path FROM p WHERE tip NOT IN (SELECT source FROM d) AND len(path) > 1")
def maximal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.maximal_paths(edges(spark, sf_dir).where("source < target")).select(F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES_SQL}, {_DAG_SQL}, {_PATHS_SQL}, f AS (SELECT id, 1 + id % 3 AS factor FROM nodes), m AS (SELECT path FROM p WHERE tip NOT IN (SELECT source FROM d) AND len(path) > 1),
    x AS (SELECT array_to_string(path, '>') AS path, unnest(path) AS id FROM m)
    SELECT path, count(*) AS n, CAST(product(factor) AS DOUBLE) AS amplification FROM x JOIN f USING (id) WHERE factor > 1 GROUP BY path HAVING count(*) > 1 AND product(factor) > 3""")
def maximal_paths_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.maximal_paths(edges(spark, sf_dir).where("source < target"))
    factors = nodes(spark, sf_dir).select("id", (F.col("id") % 3 + 1).alias("factor"))
    return graph.amplification(paths, factors, 3)


@query(f"WITH {_EDGES_SQL} SELECT id, coalesce(n, 0) AS degree FROM nodes LEFT JOIN (SELECT source, count(DISTINCT target) AS n FROM e GROUP BY 1) ON source = id WHERE coalesce(n, 0) < 1 OR coalesce(n, 0) > 1")
def cardinality_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree_bounds(edges(spark, sf_dir), nodes(spark, sf_dir), 1, 1)


@query(f"WITH {_EDGES_SQL} SELECT source, target, b.load + a.load * 1.5 AS demand FROM e JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE b.load + a.load * 1.5 > b.capacity")
def failover_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.failover_overload(edges(spark, sf_dir), nodes(spark, sf_dir), 1.5).select("source", "target", "demand")


@query(f"WITH {_EDGES_SQL} SELECT id FROM nodes WHERE capacity < load * 1.2")
def capacity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capacity_margin(nodes(spark, sf_dir), 0.2).select("id")


@query("SELECT p_brand AS rule, count(*) AS active FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49) ON l_partkey = p_partkey WHERE p_size = 1 GROUP BY 1 HAVING count(*) > 1")
def mutual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_ = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_brand").alias("rule"), F.col("p_partkey").alias("component"), F.lit("on").alias("state"))
    states = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("component"), F.lit("on").alias("state")).distinct()
    return graph.too_many_active(states, rules_, 1)


@query(f"""WITH {_EDGES_SQL}, r AS (SELECT id AS source, (id * 2 + 1) % 25 AS target, id % 2 = 0 AS wanted FROM nodes)
    SELECT source, target, wanted FROM r WHERE wanted <> EXISTS (SELECT 1 FROM e WHERE e.source = r.source AND e.target = r.target)""")
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = nodes(spark, sf_dir).select(F.col("id").alias("source"), ((F.col("id") * 2 + 1) % 25).alias("target"), (F.col("id") % 2 == 0).alias("wanted"))
    return graph.relation_violations(edges(spark, sf_dir), rule)


@query(f"""WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL}, s AS (SELECT id + 100 AS controller, id AS observed FROM nodes WHERE id % 6 = 0)
    SELECT DISTINCT s.controller, n.id FROM s JOIN nodes o ON o.id = s.observed JOIN r ON r.node = s.observed AND r.origin <> s.observed JOIN nodes n ON n.id = r.origin WHERE n.capacity < o.capacity""")
def scaling_blind_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.blind_spots(edges(spark, sf_dir), n, n.where("id % 6 = 0").select((F.col("id") + 100).alias("controller"), F.col("id").alias("observed")))
