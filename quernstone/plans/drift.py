"""Reconciliation queries: declared orders, observed lines, snapshots of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import reconcile
from quernstone.operators.history import latest

from .registry import query, table


@query("""
    SELECT code, severity, count(*) AS n FROM (
      SELECT 'MISSING_DECLARED' AS code, 'block' AS severity FROM orders o
      WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
      UNION ALL
      SELECT 'UNDECLARED', 'warning' FROM (SELECT DISTINCT l_orderkey FROM lineitem) l
      WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
      UNION ALL
      SELECT 'DUPLICATE_KEY', 'warning' FROM (
        SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    ) GROUP BY code, severity
""")
def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared orders against observed lines, with repeated line keys, counted by code."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    observed = lines.select("l_orderkey").distinct()
    match = F.col("o_orderkey") == F.col("l_orderkey")
    found = [
        orders.join(observed, match, "left_anti").select(F.lit("MISSING_DECLARED").alias("code"), F.lit("block").alias("severity")),
        observed.join(orders, match, "left_anti").select(F.lit("UNDECLARED").alias("code"), F.lit("warning").alias("severity")),
        lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.lit("DUPLICATE_KEY").alias("code"), F.lit("warning").alias("severity")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def drift_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing(_declared(spark, sf_dir), _observed(spark, sf_dir), ["k"])


@query("""
    SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (
      SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'
      UNION SELECT o_orderkey FROM orders WHERE o_totalprice < 50000)
""")
def drift_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    final, cheap = (orders.where(c).select(F.col("o_orderkey").alias("k")) for c in ("o_orderstatus = 'F'", "o_totalprice < 50000"))
    return reconcile.undeclared(_observed(spark, sf_dir), final, [cheap], ["k"])


@query("""
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'MISSING_DECLARED' ELSE 'UNDECLARED' END AS code
    FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'O') a
    FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O') b ON a.k = b.k
    WHERE a.k IS NULL OR b.k IS NULL
""")
def drift_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"))
    observed = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("k"))
    return reconcile.drift(declared, observed, ["k"])


@query("""
    SELECT p_partkey AS k, unnest(CASE WHEN p_size % 3 = 0 THEN ['class', 'function', 'method'] ELSE [p_type] END) AS kind FROM part
""")
def rule_key_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_type"))
    return reconcile.expand_rules(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), kind.alias("kind")))


@query("""
    SELECT symbol, unit, candidate_no FROM (
      SELECT a.symbol, b.unit, row_number() OVER (PARTITION BY a.symbol ORDER BY b.k) AS candidate_no FROM
      (SELECT s_name || '.' || CAST(s_nationkey AS VARCHAR) AS symbol, CAST(s_nationkey AS VARCHAR) AS leaf FROM supplier) a
      JOIN (SELECT c_name || '.' || CAST(c_nationkey AS VARCHAR) AS unit, CAST(c_nationkey AS VARCHAR) AS leaf, c_custkey AS k FROM customer) b ON a.leaf = b.leaf)
    WHERE candidate_no <= 5
""")
def moved_candidates_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = table(spark, sf_dir, "supplier").select(F.concat_ws(".", "s_name", F.col("s_nationkey").cast("string")).alias("symbol"))
    units = table(spark, sf_dir, "customer").select(F.concat_ws(".", "c_name", F.col("c_nationkey").cast("string")).alias("unit"), F.col("c_custkey").alias("k"))
    return reconcile.name_candidates(lost, units, symbol="symbol", unit_symbol="unit", order="k").select("symbol", "unit", "candidate_no")


_HALVES = """
    WITH m AS (SELECT (max(event_id) + min(event_id)) // 2 AS m FROM events),
    a AS (SELECT user_id, event_type, max_by(value, event_id) AS v FROM events, m WHERE event_id <= m AND user_id % 7 <> 3 GROUP BY 1, 2),
    b AS (SELECT user_id, event_type, max_by(value, event_id) AS v FROM events, m WHERE event_id > m AND user_id % 5 <> 2 GROUP BY 1, 2)
"""


@query(_HALVES + """
    SELECT coalesce(a.user_id || ':' || a.event_type, b.user_id || ':' || b.event_type) AS k,
           CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type
    WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.v IS DISTINCT FROM b.v
""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    middle = F.broadcast(events.agg(((F.max("event_id") + F.min("event_id")) / 2).cast("long").alias("m")))
    marked = events.join(middle)
    state = lambda df: latest(df, ["user_id", "event_type"], ["event_id"], ["value"]).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("k"), "value")
    before, after = marked.where("event_id <= m and user_id % 7 <> 3"), marked.where("event_id > m and user_id % 5 <> 2")
    return reconcile.snapshot_changes(state(before), state(after), "k", "value")


@query("""
    SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase') e
    JOIN (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + 9700 AS hi FROM orders WHERE o_totalprice > 200000) o
    ON e.user_id = o.o_custkey AND e.d BETWEEN o.lo AND o.hi
""")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("date").alias("d"))
    day = F.col("o_orderdate").cast("date")
    ranges = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("user_id"), day.alias("lo"), F.date_add(day, 9700).alias("hi"))
    return reconcile.at_location(points, ranges, "user_id", "d", "lo", "hi").select("event_id", "o_orderkey")


@query("""
    WITH d AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_returnflag = 'R'),
    i AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_returnflag <> 'R')
    SELECT source, target, 'declared' AS origin FROM d
    UNION ALL SELECT source, target, 'inferred' FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = i.source AND d.target = i.target)
""")
def declared_over_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = lambda c: table(spark, sf_dir, "lineitem").where(c).select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return reconcile.declared_over_inferred(edges("l_returnflag = 'R'"), edges("l_returnflag <> 'R'"), ["source", "target"])


@query("""
    WITH b AS (SELECT p_brand AS leaf, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_size = 7 GROUP BY 1 HAVING count(*) = 1)
    SELECT DISTINCT p.p_partkey AS source, b.target FROM part p JOIN b ON p.p_brand = b.leaf WHERE p.p_partkey <> b.target
""")
def unique_candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return reconcile.unique_candidate(part.select("p_partkey", "p_brand"), part.where("p_size = 7").select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("leaf")), source="p_partkey", leaf="p_brand", block="b", block_leaf="leaf")


@query("""
    SELECT least(a.event_id, b.event_id) AS first_unit, greatest(a.event_id, b.event_id) AS second_unit, a.r AS resource, a.t AS target FROM
    (SELECT event_id, event_type, user_id AS r, CAST(round(value) AS BIGINT) AS t FROM events WHERE event_type = 'click') a
    JOIN (SELECT event_id, event_type, user_id AS r, CAST(round(value) AS BIGINT) AS t FROM events WHERE event_type = 'purchase') b ON a.r = b.r AND a.t = b.t
""")
def conflicting_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = table(spark, sf_dir, "events").select(F.col("event_id").alias("unit"), F.col("event_type").alias("action"), F.col("user_id").alias("resource"), F.round("value").cast("long").alias("target"))
    return reconcile.opposite_actions(effects, [("click", "purchase")])


@query("""
    SELECT user_id AS resource, CAST(round(value) AS BIGINT) AS target, 'click' AS left_action, 'purchase' AS right_action, count(*) FILTER (WHERE event_type = 'click') AS n_left, count(*) FILTER (WHERE event_type = 'purchase') AS n_right,
           min(event_id) FILTER (WHERE event_type = 'click') AS left_unit, min(event_id) FILTER (WHERE event_type = 'purchase') AS right_unit
    FROM events WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_type = 'click') > 0 AND count(*) FILTER (WHERE event_type = 'purchase') > 0
""")
def conflicting_effect_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = table(spark, sf_dir, "events").select(F.col("event_id").alias("unit"), F.col("event_type").alias("action"), F.col("user_id").alias("resource"), F.round("value").cast("long").alias("target"))
    return reconcile.opposed_groups(effects, [("click", "purchase")])


@query("""
    WITH a AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0),
    b AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0),
    p AS (SELECT b.id AS after_id, coalesce(x.id, y.id) AS before_id, b.v, coalesce(x.v, y.v) AS bv FROM b LEFT JOIN a x ON x.id = b.id LEFT JOIN a y ON y.name = b.name)
    SELECT after_id, before_id, CASE WHEN before_id IS NULL THEN 'created' WHEN v IS DISTINCT FROM bv THEN 'modified' ELSE 'same' END AS change FROM p
    UNION ALL SELECT NULL, id, 'removed' FROM a WHERE id NOT IN (SELECT before_id FROM p WHERE before_id IS NOT NULL)
""")
def priority_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    before = c.where(key % 3 != 0).select(key.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("v"))
    after = c.where(key % 7 != 0).select(F.when(key % 5 == 0, -key).otherwise(key).alias("id"), F.col("c_name").alias("name"), F.when(key % 4 == 0, "other").otherwise(F.col("c_mktsegment")).alias("v"))
    return reconcile.pair_by_priority(after, before, ["id", "name"], "v")


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
