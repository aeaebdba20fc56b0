"""Rule and report queries: repeated keys, statuses, groups, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scalars import STATUSES
from quernstone.operators import rules

from .catalogue import _BLOCKS_SQL, blocks
from .registry import query, table


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_artifact_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey").distinct()


@query(f"WITH {_BLOCKS_SQL} SELECT uid, 'status' AS missing FROM blocks WHERE status IS NULL")
def incomplete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_fields(blocks(spark, sf_dir), ["uid", "name", "domain", "status"]).select("uid", "missing")


@query(f"WITH {_BLOCKS_SQL} SELECT uid, kind FROM blocks WHERE kind NOT IN ({', '.join(repr(x) for x in STATUSES)})")
def invalid_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.invalid_status(blocks(spark, sf_dir), "kind").select("uid", "kind")


@query(f"""WITH {_BLOCKS_SQL}, f AS (
      SELECT 'INCOMPLETE' AS code, 'block' AS severity FROM blocks WHERE status IS NULL
      UNION ALL SELECT 'DUPLICATE', 'warning' FROM (SELECT name, domain FROM blocks GROUP BY 1, 2 HAVING count(*) > 1)
      UNION ALL SELECT 'LARGE', 'info' FROM blocks WHERE size > 45)
    SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'block') AS n_block, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info,
           count(*) FILTER (WHERE severity = 'block') = 0 AS allowed FROM f""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(_findings(spark, sf_dir))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run_rules(blocks(spark, sf_dir), [
        lambda df: rules.finding(rules.missing_fields(df, ["status"]), "INCOMPLETE", "block", F.col("uid"), F.col("missing")),
        lambda df: rules.finding(rules.repeated_keys(df, ["name", "domain"]), "DUPLICATE", "warning", F.col("name"), F.col("n")),
        lambda df: rules.finding(df.where("size > 45"), "LARGE", "info", F.col("uid"), F.col("size")),
    ])


@query(f"""WITH {_BLOCKS_SQL}, f AS (SELECT count(*) FILTER (WHERE status IS NULL) AS a, count(*) FILTER (WHERE size > 45) AS b FROM blocks)
    SELECT 'structure' AS dimension, CASE WHEN a > 0 THEN 'fail' ELSE 'ok' END AS state FROM f UNION ALL SELECT 'size', CASE WHEN b > 0 THEN 'warn' ELSE 'ok' END FROM f UNION ALL SELECT 'security', 'ok'""")
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.status_rollup(_findings(spark, sf_dir), {"structure": ["INCOMPLETE"], "size": ["LARGE"], "security": ["SECRET"]})


@query("SELECT lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS purpose, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 AND lower(trim(regexp_replace(any_value(text), '[ \t\n\r]+', ' ', 'g'))) <> ''")
def purpose_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.repeated_purposes(table(spark, sf_dir, "documents"), "text", F.lit(True))


@query("""
    WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
    SELECT h, n FROM g WHERE h NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1)
""")
def allowed_duplicates_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    policy = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "reviewed").alias("reason"))
    return rules.suppressed(rules.repeated_keys(docs, ["h"]), docs, policy, "h", "doc_id")


@query("""
    SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS group_size,
           CASE WHEN count(*) OVER (PARTITION BY sha256(text)) < 2 THEN 'no' WHEN lang = 'en' THEN 'yes' ELSE 'check' END AS duplicated FROM documents
""")
def group_size_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.when(F.col("lang") == "en", "strong").otherwise("weak").alias("strength"))
    return rules.group_size(docs, ["h"], "strength").select("doc_id", "group_size", "duplicated")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def keep_best_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.keep_best(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["-value", "event_id"]).select("event_type", "event_id", "value")


@query("SELECT event_type, event_id, seq FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS seq FROM events) WHERE seq <= 8")
def first_findings_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_per_group(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], [F.col("event_id")], 8)


@query("SELECT c_nationkey, count(*) AS n, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS members FROM customer GROUP BY 1 HAVING count(*) >= 2")
def grouped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.repeated(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("""
    SELECT event_id, 'user_id' AS field, CAST(user_id AS VARCHAR) AS stored, CAST(CASE WHEN event_id % 9 = 0 THEN 0 ELSE user_id END AS VARCHAR) AS raw FROM events WHERE event_id % 9 = 0 AND user_id <> 0
""")
def projection_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.to_json(F.struct(F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), "event_type"))
    return rules.projection_mismatch(e.withColumn("raw", raw), "raw", ["user_id", "event_type"], "event_id")


@query("""
    SELECT 'SELF_EDGE' AS code, n_nationkey || '>' || n_nationkey AS subject FROM nation WHERE FALSE
    UNION ALL SELECT 'DUPLICATE_ID', CAST(n_regionkey AS VARCHAR) FROM nation GROUP BY n_regionkey HAVING count(*) > 1
    UNION ALL SELECT 'DANGLING_EDGE', n_regionkey || '>' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT n_regionkey FROM nation)
    UNION ALL SELECT 'SELF_EDGE', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey = n_nationkey
    UNION ALL SELECT 'UNKNOWN_RELATIONSHIP', 'odd' FROM nation WHERE n_nationkey % 10 = 0
""")
def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target"), F.when(F.col("n_nationkey") % 10 == 0, "odd").otherwise("uses").alias("relationship"))
    return rules.plan_errors(n.select(F.col("n_regionkey").alias("id")), edges, ["uses"])


@query("SELECT p_brand, count(*) AS n, sum(p_size) AS total, count(*) FILTER (WHERE p_size > 25) AS large FROM part GROUP BY 1")
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("decimal(38,0)").cast("long").alias("total"), F.count_if(F.col("p_size") > 25).alias("large"))
