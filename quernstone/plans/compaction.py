"""Queries of compacted closures and of the greedy choice of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import closures as cl
from quernstone.operators import inference as inf
from quernstone.operators.publish import work_folder

from .registry import query, table

#: Customers of a component, and what an event's closure lacks of it.
GROUP = 20


def _kept(spark: SparkSession, sf_dir: str) -> cl.Compacted:
    """Closures of orders: the customers of their customer's group, less those whose number clashes with the order's, written and read again."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").cast("long").alias("owner"))
    members = table(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {GROUP}").alias("g"), F.col("c_custkey").cast("long").alias("member"))
    rows = orders.join(members, F.expr(f"owner div {GROUP}") == F.col("g")).where("owner <> member")
    lacks = F.when(F.col("event") % 5 == 0, F.col("member") % 4 != 0).otherwise(F.col("member") % 7 == F.col("event") % 7)
    kept = cl.compact(rows.where(~lacks).select("event", "member"), orders)
    folder = f"{work_folder(spark)}/closures"
    kept.write(folder)
    return cl.Compacted.read(spark, folder)


_CLOSURES = f"""
    r AS (SELECT o_orderkey AS event, o_custkey AS owner, c_custkey AS member FROM orders JOIN customer ON o_custkey // {GROUP} = c_custkey // {GROUP} AND o_custkey <> c_custkey
          WHERE CASE WHEN o_orderkey % 5 = 0 THEN c_custkey % 4 = 0 ELSE c_custkey % 7 <> o_orderkey % 7 END)
"""


@query(f"WITH {_CLOSURES} SELECT event, count(*) AS n, sum(member)::BIGINT AS total, min(member) AS least, max(member) AS most FROM r GROUP BY event")
def expanded_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl.expand(_kept(spark, sf_dir))
    return rows.groupBy("event").agg(F.count("*").alias("n"), F.sum("member").alias("total"), F.min("member").alias("least"), F.max("member").alias("most"))


@query(f"""
    WITH {_CLOSURES},
    g AS (SELECT c_custkey // {GROUP} AS g, count(*) AS size FROM customer GROUP BY 1),
    n AS (SELECT event, any_value(owner) AS owner, count(*) AS n FROM r GROUP BY event),
    p AS (SELECT *, size - 1 - n AS lacks FROM n JOIN g ON owner // {GROUP} = g)
    SELECT 'events' AS part, count(*) AS n FROM orders
    UNION ALL SELECT 'members', sum(size)::BIGINT FROM g WHERE g IN (SELECT g FROM p WHERE lacks < n)
    UNION ALL SELECT 'missing', sum(lacks)::BIGINT FROM p WHERE lacks < n
    UNION ALL SELECT 'inline', sum(n)::BIGINT FROM p WHERE lacks >= n
""")
def compacted_closure_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).sizes()


@query("""
    WITH RECURSIVE g AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS items, 1 + l_suppkey % 3 AS w FROM lineitem GROUP BY l_suppkey),
    r AS (SELECT *, row_number() OVER (ORDER BY len(items) * w DESC, len(items) DESC, k) AS rank FROM g),
    t(rank, used, k, mine) AS (
      SELECT 0::BIGINT, [-1::BIGINT], NULL::BIGINT, []::BIGINT[]
      UNION ALL
      SELECT rank, CASE WHEN len(f) >= 40 THEN list_concat(used, f) ELSE used END, k, f
      FROM (SELECT r.rank, t.used, r.k, list_filter(r.items, lambda x: NOT list_contains(t.used, x)) AS f FROM t JOIN r ON r.rank = t.rank + 1))
    SELECT k AS supplier, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS place, len(mine) AS n, list_sum(mine)::BIGINT AS total FROM t WHERE rank > 0 AND len(mine) >= 40
""")
def greedy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by their parts, each with the parts that no one before it took, if there are 40."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_partkey").cast("long").alias("item"), (F.col("l_suppkey") % 3 + 1).alias("weight"))
    out = inf.greedy_moves(rows, "weight", least=40)
    return out.select(F.col("group").alias("supplier"), "place", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
