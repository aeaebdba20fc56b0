"""History, journal and effect queries over events, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import scalars
from quernstone.operators import analysis, history, store

from .registry import query, table


@query("SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], ["value", "event_id"])


@query("""
    SELECT event_id, event_type, previous, drift FROM (
      SELECT event_id, event_type, lag(event_type) OVER w AS previous,
             CASE WHEN row_number() OVER w = 1 THEN 'baseline' WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 'content_drift' END AS drift
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE drift IS NOT NULL
""")
def consecutive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.consecutive(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_type").select("event_id", "event_type", "previous", "drift")


_VERSIONS = """
    a AS (SELECT c_custkey AS id, c_mktsegment AS intent, c_nationkey AS artifacts, c_acctbal AS notes FROM customer WHERE c_custkey % 10 <> 0),
    b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_mktsegment END AS intent, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_nationkey END AS artifacts,
          CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS notes FROM customer WHERE c_custkey % 11 <> 0)
"""


@query(f"""
    WITH {_VERSIONS}
    SELECT * FROM (
      SELECT coalesce(a.id, b.id) AS id,
        CASE WHEN a.id IS NULL THEN 'block.created' WHEN b.id IS NULL THEN 'block.removed' WHEN a.intent <> b.intent THEN 'intent.changed'
             WHEN a.artifacts <> b.artifacts THEN 'artifacts.changed' WHEN a.notes <> b.notes THEN 'metadata.changed' END AS event_type,
        concat_ws(',', CASE WHEN a.artifacts IS DISTINCT FROM b.artifacts THEN 'artifacts' END, CASE WHEN a.intent IS DISTINCT FROM b.intent THEN 'intent' END, CASE WHEN a.notes IS DISTINCT FROM b.notes THEN 'notes' END) AS changed_fields
      FROM a FULL JOIN b ON a.id = b.id) WHERE event_type IS NOT NULL
""")
def change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    a = c.where(k % 10 != 0).select(k.alias("id"), F.col("c_mktsegment").alias("intent"), F.col("c_nationkey").alias("artifacts"), F.col("c_acctbal").alias("notes"))
    b = c.where(k % 11 != 0).select(k.alias("id"), F.when(k % 3 == 0, "x").otherwise(F.col("c_mktsegment")).alias("intent"), F.when(k % 4 == 0, -1).otherwise(F.col("c_nationkey")).alias("artifacts"), F.when(k % 7 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("notes"))
    return history.capture(a, b, "id", ["intent", "artifacts", "notes"])


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("user_id").cast("string").alias("uid"), F.concat(F.lit("b"), (F.col("user_id") % 10).cast("string")).alias("block_id"), F.col("props").alias("payload"), "value")


@query("SELECT event_id, event_type FROM events WHERE user_id = 42 OR 'b' || CAST(user_id % 10 AS VARCHAR) = '42' ORDER BY ts DESC, event_id DESC LIMIT 20")
def ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ledger(_ledger(spark, sf_dir), "42", ["uid", "block_id"], limit=20).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND (CAST(user_id AS VARCHAR) = 'b7' OR 'b' || CAST(user_id % 10 AS VARCHAR) = 'b7')")
def ledger_query_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ledger(_ledger(spark, sf_dir), "b7", ["uid", "block_id"], types=["click", "purchase"]).select("event_id")


@query("SELECT event_id FROM events WHERE props ILIKE '%K_: 1%'")
def ledger_search_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.search(_ledger(spark, sf_dir), "K_: 1", "payload").select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND length(props) > 0 ORDER BY ts DESC, event_id DESC LIMIT 20")
def ledger_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.why(_ledger(spark, sf_dir), ["purchase"], "payload").select("event_id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"])


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def objects_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_wins(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id"), "digest", ["doc_id"])


@query("SELECT DISTINCT sha256(replace(props, ' ', '')) AS digest, replace(props, ' ', '') AS content FROM events WHERE props IS NOT NULL")
def content_addressed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.content_objects(table(spark, sf_dir, "events"), "props")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500) AND event_type <> 'error'")
def prunable_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return history.prunable(events.select("event_id", F.col("event_id").alias("revision")), 500, "revision", events.where("event_type = 'error'"), "event_id").select("event_id")


@query("SELECT count(*) AS n, CAST(coalesce(sum(strlen(event_type)) + sum(strlen(props)), 0) AS BIGINT) AS n_bytes FROM events")
def delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sizes(table(spark, sf_dir, "events"), "event_type", "props")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_bytes FROM events")
def delta_sizes_null_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sizes(table(spark, sf_dir, "events").withColumn("none", F.lit(None).cast("string")), "event_type", "none")


@query("""
    SELECT r.k, CASE WHEN e.k IS NULL THEN 'missing' WHEN e.status <> 'pass' OR e.fp IS DISTINCT FROM r.fp THEN 'stale' ELSE 'fresh' END AS state
    FROM (SELECT c_custkey AS k, c_nationkey AS fp FROM customer) r
    LEFT JOIN (SELECT o_custkey AS k, CASE max_by(o_orderstatus, o_orderkey) WHEN 'F' THEN 'pass' ELSE 'fail' END AS status, CAST(max(o_orderkey) % 2 AS INTEGER) * 100 + 5 AS fp FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1) e ON e.k = r.k
""")
def evidence_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("fingerprint"))
    last = history.latest(table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0"), ["o_custkey"], ["o_orderkey"], ["o_orderstatus", "o_orderkey"])
    evidence = last.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("status"), (F.col("o_orderkey") % 2 * 100 + 5).cast("int").alias("fingerprint"))
    return history.freshness(required, evidence, "k")


@query("SELECT l_orderkey, sha256(string_agg(row, chr(10) ORDER BY row)) AS fingerprint FROM (SELECT l_orderkey, '{\"l_linenumber\":' || l_linenumber || ',\"l_partkey\":' || l_partkey || '}' AS row FROM lineitem) GROUP BY 1")
def group_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.fingerprint(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query("""
    SELECT c_custkey, field, value, was FROM (
      SELECT c_custkey, 'c_mktsegment' AS field, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS value, c_mktsegment AS was FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT c_custkey, 'c_nationkey', CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0)
    WHERE value IS DISTINCT FROM was
""")
def csv_table_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, k = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("c_custkey")
    rows = base.where(k % 2 == 0).select(k, F.when(k % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 7 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    return store.csv_edits(rows, base, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""
    SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT s_suppkey, 'new ' || s_name FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT -s_suppkey, s_name FROM supplier WHERE s_suppkey < 10
""")
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    new = s.where(k % 3 == 0).select(k.alias("k"), F.concat(F.lit("new "), "s_name").alias("v")).unionByName(s.where(k < 10).select((-k).alias("k"), F.col("s_name").alias("v")))
    return store.upsert(s.select(k.alias("k"), F.col("s_name").alias("v")), new, "k")


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    conf = F.when(F.col("event_id") % 3 == 0, "high").otherwise("low")
    return e.select(F.col("user_id").alias("unit"), "event_id", F.col("event_type").alias("action"), (F.col("event_id") % 13).alias("resource"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 7).alias("target"), conf.alias("confidence"))


_EFFECTS = """
    e AS (SELECT user_id AS unit, event_id, event_type AS action, event_id % 13 AS resource, CASE WHEN event_id % 4 = 0 THEN event_id % 7 END AS target,
          CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM events),
    p AS (SELECT unit, min(event_id) FILTER (WHERE s = m) AS event_id FROM (
          SELECT *, max(s) OVER (PARTITION BY unit) AS m FROM (SELECT *, 70 + CASE WHEN target IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN confidence = 'high' THEN 10 ELSE 0 END AS s FROM e)) GROUP BY unit),
    f AS (SELECT e.* FROM e JOIN p USING (unit, event_id))
"""


@query(f"WITH {_EFFECTS} SELECT unit, event_id, action FROM f")
def primary_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _primary(spark, sf_dir).select("unit", "event_id", "action")


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = analysis.effect_priority(F.col("action"), F.col("resource").cast("string"), F.col("target").cast("string"), F.col("confidence"))
    return analysis.primary(_effects(spark, sf_dir).withColumn("score", score), "unit", "score", "event_id")


@query(f"WITH {_EFFECTS} SELECT action, resource, target, count(DISTINCT unit) AS n FROM f GROUP BY 1, 2, 3 HAVING count(DISTINCT unit) >= 2")
def same_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.same_outcome(_primary(spark, sf_dir), "unit", ["action", "resource", "target"])


@query("SELECT event_type AS action, CAST(floor(value) AS BIGINT) AS resource, count(DISTINCT user_id) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2 HAVING count(DISTINCT user_id) BETWEEN 2 AND 8")
def similar_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 4 <> 0")
    effects = e.select(F.col("user_id").alias("unit"), F.col("event_type").alias("action"), F.floor("value").alias("resource"))
    return analysis.same_outcome(effects, "unit", ["action", "resource"], most=8)


@query("""
    SELECT p_partkey, CASE WHEN p_size > 25 AND p_brand = 'Brand#12' THEN 'big' ELSE p_type END AS p_type FROM part
""")
def bulk_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (F.col("p_size") > 25) & (F.lower("p_brand") == "brand#12")
    return analysis.mutate(table(spark, sf_dir, "part"), "set", "p_type", where, value="big").select("p_partkey", "p_type")


@query("SELECT p_brand, p_type, n, 'profile_' || row_number() OVER (ORDER BY n DESC, p_brand, p_type) AS profile FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 3)")
def compacted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.compact_profiles(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 3)


@query("""
    WITH t AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: regexp_matches(x, '^[a-z][a-z0-9]*$')) AS w FROM documents),
    u AS (SELECT doc_id, lang, w, unnest(range(1, len(w) + 1)) AS i FROM t),
    x AS (SELECT doc_id, lang, 1 AS size, w[i] AS gram FROM u UNION ALL SELECT doc_id, lang, 2, w[i] || ' ' || w[i + 1] FROM u WHERE i < len(w) UNION ALL SELECT doc_id, lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM u WHERE i < len(w) - 1),
    g AS (SELECT lang, size, gram, count(*) AS pw FROM x GROUP BY ALL),
    i AS (SELECT doc_id, size, gram, count(*) AS iw FROM x GROUP BY ALL),
    s AS (SELECT doc_id, lang, sum(CASE size WHEN 1 THEN 2.0 WHEN 2 THEN 5.0 ELSE 8.0 END * least(iw, pw)) AS score FROM i JOIN g USING (size, gram) GROUP BY 1, 2)
    SELECT doc_id, lang, CAST(score AS DOUBLE) AS score, CAST(slot AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS slot FROM s WHERE score >= 6) WHERE slot <= 3
""")
def profile_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x.rlike("^[a-z][a-z0-9]*$"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("tokens"))
    scores = analysis.label_scores(docs, "doc_id", "lang", "tokens").withColumn("score", F.col("score").cast("double"))
    return analysis.top_labels(scores, "doc_id", "lang")


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", scalars.digest(F.col("text")).alias("digest"))
