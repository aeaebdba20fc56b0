"""Catalogue queries over parts (records), lines (relations) and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scalars import STATUSES
from quernstone.operators import catalogue as c

from .registry import query, table

_BLOCKS_SQL = """
    blocks AS (SELECT p_partkey AS uid, p_name AS name, p_brand AS domain, p_type AS kind,
      CASE p_size % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'experimental' WHEN 2 THEN 'legacy' WHEN 3 THEN 'deprecated' END AS status, p_size AS size
    FROM part)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue records; every fifth has no status."""
    k = F.col("p_size") % 5
    status = F.when(k == 0, "active").when(k == 1, "experimental").when(k == 2, "legacy").when(k == 3, "deprecated")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"), F.col("p_brand").alias("domain"), F.col("p_type").alias("kind"), status.alias("status"), F.col("p_size").alias("size"))


@query(f"WITH {_BLOCKS_SQL} SELECT uid, coalesce(status, '') AS k FROM blocks WHERE (coalesce(status, ''), uid) > ('active', 100) ORDER BY coalesce(status, ''), uid LIMIT 30")
def catalogue_page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.keyset(blocks(spark, sf_dir), "status", "uid", after=("active", 100), limit=30).select("uid", F.coalesce("status", F.lit("")).alias("k"))


@query(f"WITH {_BLOCKS_SQL} SELECT uid, name FROM blocks WHERE (name, uid) < ('part 5', 50) ORDER BY name DESC, uid DESC LIMIT 30")
def catalogue_page_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.keyset(blocks(spark, sf_dir), "name", "uid", before=("part 5", 50), limit=30).select("uid", "name")


@query(f"WITH {_BLOCKS_SQL} SELECT uid, size FROM blocks WHERE (size, uid) < (30, 100) ORDER BY size DESC, uid DESC LIMIT 25")
def catalogue_page_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.keyset(blocks(spark, sf_dir), "size", "uid", descending=True, after=(30, 100), limit=25).select("uid", "size")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.offset_page(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), c.mixed_order("c_acctbal", "c_custkey"), 40, 20)


@query(f"WITH {_BLOCKS_SQL} SELECT uid, left(name, 161) AS name FROM blocks WHERE domain = 'Brand#12' AND size = 7 OR FALSE")
def equality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c.Query(filters={"domain": "Brand#12", "size": "7"})
    return c.select(blocks(spark, sf_dir), q, filterable=["domain", "status", "size"], searchable=[]).select("uid", F.substring("name", 1, 161).alias("name"))


@query(f"WITH {_BLOCKS_SQL} SELECT uid FROM blocks WHERE contains(lower(name), 'pro') OR contains(lower(domain), 'pro') OR contains(lower(coalesce(status, '')), 'pro') OR contains(lower(kind), 'pro')")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.select(blocks(spark, sf_dir), c.Query(search="PRO"), filterable=[], searchable=["name", "domain", "status", "kind"]).select("uid")


@query(f"WITH {_BLOCKS_SQL} SELECT uid FROM blocks WHERE size % 7 = 0")
def catalogue_search_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("name", F.concat("name", F.when(F.col("size") % 7 == 0, " 5%_x").otherwise(" 5 percent x")))
    return c.select(rows, c.Query(search="5%_X"), filterable=[], searchable=["name"]).select("uid")


@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)), '7 customer')")
def search_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(c.anywhere("7 CUSTOMER", ["c_custkey", "c_name", "c_mktsegment"])).select("c_custkey")


@query(f"WITH {_BLOCKS_SQL} SELECT domain, count(*) AS n FROM blocks GROUP BY domain")
def facets_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.facets(blocks(spark, sf_dir), "domain")


@query(f"WITH {_BLOCKS_SQL} SELECT status, count(*) AS n FROM blocks GROUP BY status")
def facets_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.facets(blocks(spark, sf_dir), "status")


@query(f"WITH {_BLOCKS_SQL} SELECT s.status, count(b.uid) AS n FROM (VALUES {', '.join(f'({x!r})' for x in STATUSES)}) s(status) LEFT JOIN blocks b ON b.status = s.status AND b.size > 48 GROUP BY s.status")
def facets_status_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.zero_filled(blocks(spark, sf_dir).where("size > 48"), "status", STATUSES)


@query(f"WITH {_BLOCKS_SQL} SELECT count(*) AS n FROM blocks WHERE status = 'active'")
def count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.select(blocks(spark, sf_dir), c.Query(filters={"status": "active"}), filterable=["status"], searchable=[]).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7) ORDER BY p_partkey LIMIT 51")
def relations_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return c.incoming(edges, table(spark, sf_dir, "part").select("p_partkey", "p_name"), 7, 50, key="p_partkey")


@query("""
    SELECT r.lit, coalesce(u.u, e.x) AS resolved FROM (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'Supplier ' || l_suppkey END AS lit FROM lineitem) r
    LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS u FROM supplier) u ON u.u = r.lit
    LEFT JOIN (SELECT s_name, min(CAST(s_suppkey AS VARCHAR)) AS x FROM supplier GROUP BY 1) e ON e.s_name = r.lit
""")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")))
    return c.resolve(table(spark, sf_dir, "lineitem").select(lit.alias("lit")).distinct(), table(spark, sf_dir, "supplier"), "lit", "s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1)")
def bounded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    segment = customers.where("c_custkey = 1").select("c_mktsegment")
    return c.bounded(customers.join(segment, "c_mktsegment", "left_semi").select("c_custkey"), most=None)


@query("""
    SELECT s_suppkey AS uid, list(l_orderkey ORDER BY l_orderkey, l_linenumber) AS children FROM supplier
    LEFT JOIN (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50) ON s_suppkey = l_suppkey WHERE l_orderkey IS NOT NULL GROUP BY 1
    UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)
""")
def records_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    kids = kids.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("c"))
    return table(spark, sf_dir, "supplier").join(kids, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("uid"), F.col("c.l_orderkey").alias("children"))
