"""Queries of plans of changes, invariants and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import changes as ch
from quernstone.operators import digest as tree
from quernstone.operators import invariants as inv

from .registry import query, table
from .stores import tree_sql

K = "p_partkey"


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'A person has to confirm this change.'
      WHEN p_type = 'ECONOMY' AND p_size <= 25 THEN NULL WHEN p_type = 'ECONOMY' THEN 'The evidence does not name exactly one match.' ELSE 'A person has to confirm this change.' END AS reason
    FROM part
""")
def request_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    good = F.col("p_size") <= 25
    evidence = F.struct(good.alias("exact_content_match"), *[F.lit(v).alias(n) for n, v in ch.EVIDENCE.items() if n != "exact_content_match"], F.lit(0).alias("competing_candidates"))
    source = F.when(k % 4 == 1, "person").when(k % 4 == 2, "safe_mechanical_update").otherwise("controlled_refactor")
    requests = table(spark, sf_dir, "part").select(K, F.col("p_type").alias("kind"), source.alias("source"), (k % 4 == 0).alias("human_confirmed"), evidence.alias("evidence"))
    return ch.blocked_reason(requests, ["ECONOMY"]).select(K, "reason")


@query("""
    WITH c AS (SELECT o_custkey AS id, o_orderkey AS k FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 8 = 3),
    s AS (SELECT id, min(k) AS k FROM c GROUP BY id HAVING count(*) = 1)
    SELECT id, 'p' || k AS path, 's' || k AS symbol FROM s JOIN customer ON c_custkey = id JOIN orders ON o_orderkey = k WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0
""")
def safe_mechanical_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lost = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("function").alias("kind"), F.lit("F").alias("body_hash"))
    candidates = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0 and o_orderkey % 8 = 3").select(F.col("o_custkey").alias("id"), F.concat(F.lit("p"), k).alias("path"), F.concat(F.lit("s"), k).alias("symbol"), F.lit("function").alias("kind"), F.col("o_orderstatus").alias("body_hash"), (k % 5 == 0).alias("dangerous"))
    return ch.mechanical_matches(lost, candidates)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'update' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'add' END AS operation, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unsupported change kind: ' || event_type END AS error FROM events")
def change_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("click", "update"), ("view", "read"), ("purchase", "add")], "kind string, operation string")
    return ch.operations(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind")), kinds).select("event_id", "operation", "error")


@query("""
    WITH s AS (SELECT user_id % 400 AS k, event_id AS seq, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'clear' ELSE 'update' END AS op, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS field, CAST(event_id AS VARCHAR) AS v FROM events WHERE event_id % 9 = 0),
    l AS (SELECT k, max(seq) AS seq, arg_max(op, seq) AS op FROM s WHERE op IN ('add', 'delete') GROUP BY k),
    f AS (SELECT s.k, s.field, arg_max(s.op, s.seq) AS op, arg_max(s.v, s.seq) AS v FROM s LEFT JOIN l USING (k) WHERE s.op IN ('update', 'clear') AND s.seq > coalesce(l.seq, -1) GROUP BY 1, 2),
    r AS (SELECT n_nationkey AS k, n_name AS a, 'x' AS b FROM nation),
    e AS (SELECT k FROM r UNION SELECT k FROM l WHERE op = 'add')
    SELECT e.k, CASE WHEN fa.op = 'update' THEN fa.v WHEN fa.op IS NULL AND l.op IS NULL THEN r.a END AS a, CASE WHEN fb.op = 'update' THEN fb.v WHEN fb.op IS NULL AND l.op IS NULL THEN r.b END AS b
    FROM e LEFT JOIN r USING (k) LEFT JOIN l USING (k) LEFT JOIN f fa ON fa.k = e.k AND fa.field = 'a' LEFT JOIN f fb ON fb.k = e.k AND fb.field = 'b' WHERE coalesce(l.op, 'add') = 'add'
""")
def plan_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "clear").otherwise("update")
    field = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    steps = table(spark, sf_dir, "events").where("event_id % 9 = 0").select((F.col("user_id") % 400).cast("long").alias("k"), F.col("event_id").alias("seq"), op.alias("operation"), field.alias("field"), F.col("event_id").cast("string").alias("value"))
    records = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("a"), F.lit("x").alias("b"))
    return ch.folded(records, steps, "k")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 5 = 1")
def stale_plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    stamps = c.where(k % 6 != 0).select("c_custkey", F.when(k % 5 == 1, -1).otherwise(F.col("c_nationkey")).alias("size"), F.lit(None).cast("string").alias("hash"))
    return ch.stale(c.select("c_custkey", F.col("c_nationkey").alias("size"), F.lit(None).cast("string").alias("hash")), stamps, "c_custkey", ["size", "hash"]).select("c_custkey")


@query("""
    WITH r AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0 AND p_size <= 30)
    SELECT count(*) AS n_removable, count(*) FILTER (WHERE p_partkey % 4 = 0) AS n_custom, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS n_referenced FROM r
""")
def regranulation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col(K).alias("id"), "p_size")
    removable = ch.regranulation(part, part.where("id % 2 = 0"), part.where("p_size > 30"), ["id"])
    references = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("target"))
    return ch.regranulation_refusals(removable, references, F.when(F.col("id") % 4 == 0, "custom").otherwise("none"))


@query("""
    WITH a AS (SELECT DISTINCT l_orderkey, l_partkey, 0 AS v FROM lineitem WHERE l_partkey % 5 <> 0), b AS (SELECT DISTINCT l_orderkey, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_partkey % 6 <> 0)
    SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, 'artifact.' || CASE WHEN a.l_orderkey IS NULL THEN 'bound' WHEN b.l_orderkey IS NULL THEN 'unbound' ELSE 'modified' END AS event_type
    FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey WHERE a.v IS DISTINCT FROM b.v
""")
def child_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct(), F.col("l_partkey")
    a, b = rows.where(p % 5 != 0).withColumn("v", F.lit(0)), rows.where(p % 6 != 0).withColumn("v", F.when(p % 7 == 0, 1).otherwise(0))
    return ch.child_changes(a, b, "l_orderkey", "l_partkey", ["v"], "artifact")


_INTENT = """
    i AS (SELECT o_custkey AS id, string_agg('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}', chr(10) ORDER BY '{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}') AS items FROM orders GROUP BY 1),
    d AS (SELECT c_custkey AS id, sha256(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '{"a":1,"b":"' || c_mktsegment || '"}' ELSE '' END || CASE WHEN items IS NULL THEN '' ELSE chr(10) || items END) AS digest
          FROM customer LEFT JOIN i ON i.id = c_custkey WHERE items IS NOT NULL OR c_custkey % 3 = 0)
"""


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    intent = F.when(k % 3 == 0, F.concat(F.lit('{"b": "'), "c_mktsegment", F.lit('", "a": 1}')))
    blocks = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("purpose"), intent.alias("intent"))
    item = F.concat(F.lit('{"s": "'), "o_orderstatus", F.lit('", "k": '), "o_orderkey", F.lit("}"))
    return ch.intent_digests(blocks, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), item.alias("item")))


@query(f"WITH {_INTENT}, r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, digest FROM d), {tree_sql('r')} SELECT digest AS fingerprint FROM n{tree.HEIGHT}")
def intent_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.intent_fingerprint(_digests(spark, sf_dir))


@query(f"WITH {_INTENT} SELECT id, CASE WHEN id % 5 = 0 THEN 'added' WHEN id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM d WHERE id % 5 = 0 AND id % 7 <> 0 OR id % 7 = 0 AND id % 5 <> 0 OR id % 11 = 0 AND id % 5 <> 0 AND id % 7 <> 0")
def intent_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _digests(spark, sf_dir), F.col("id")
    return ch.accepted_differences(d.where(k % 5 != 0), d.where(k % 7 != 0).withColumn("digest", F.when(k % 11 == 0, "other").otherwise(F.col("digest"))))


@query("SELECT p_partkey, lower(p_brand) || ':' || replace(lower(p_name), ' ', '_') || CASE WHEN p_size % 2 = 0 THEN ':' || p_size ELSE '' END AS stable_id, sha256('{\"kind\":\"' || p_type || '\",\"size\":' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || '}') AS digest FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select(K, ch.stable_id([F.concat(F.lit("  "), "p_brand"), F.regexp_replace("p_name", " ", "   "), size.cast("string")]).alias("stable_id"), ch.evidence_digest(size.alias("size"), F.col("p_type").alias("kind")).alias("digest"))


@query("SELECT min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_brand")
def history_objects_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(K, F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("digest"))
    return ch.first_seen(rows, "digest", [K]).select(K)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'stale' WHEN p_size % 5 = 0 THEN 'irreproducible' ELSE 'apply' END AS state FROM part")
def plan_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, name, d = F.col("p_size"), F.col("p_name"), lambda c: F.sha2(c, 256)
    state = ch.plan_state(F.lit("apply"), d(name), d("p_brand"), d(F.when(s % 3 == 0, "x").otherwise(name)), d(F.when(s % 5 == 0, "y").otherwise(F.col("p_brand"))))
    return table(spark, sf_dir, "part").select(K, state.alias("state"))


# invariants and findings


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN NOT p_size < 25 THEN 'INVARIANT_VIOLATION' END WHEN 1 THEN CASE WHEN NOT p_retailprice > 1000 THEN 'INVARIANT_VIOLATION' END
      WHEN 2 THEN 'INVARIANT_UNSUPPORTED_TYPE' WHEN 3 THEN 'INVARIANT_CONFIGURATION_ERROR' WHEN 4 THEN 'INVARIANT_UNSUPPORTED_TYPE' END AS code FROM part
    WHERE p_partkey % 6 IN (2, 3, 4) OR p_partkey % 6 = 0 AND p_size >= 25 OR p_partkey % 6 = 1 AND p_retailprice <= 1000
""")
def invariant_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K) % 6
    kind = F.when(k == 0, "Value less than").when(k == 1, "value_greater_than").when(k == 2, "").when(k == 3, "value_less_than").when(k == 4, "sorted").otherwise("custom_evidence")
    actual = F.when(k == 1, F.col("p_retailprice")).otherwise(F.col("p_size").cast("double"))
    rows = table(spark, sf_dir, "part").select(K, kind.alias("type"), actual.alias("actual"), F.when(k != 3, "25").otherwise("many").alias("max"), F.lit(1000).alias("min"))
    return inv.evaluate(rows).select(K, "code")


_STATES = "s AS (SELECT s_suppkey AS component, s_nationkey % 3 AS state FROM supplier), q AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS component, 1 AS expected FROM lineitem WHERE l_orderkey % 4 = 0)"


def _required(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    states = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("component"), (F.col("s_nationkey") % 3).alias("state"))
    required = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("component"), F.lit(1).alias("expected")).distinct()
    return required, states


@query(f"WITH {_STATES} SELECT id, count(*) AS failures FROM q LEFT JOIN s USING (component) WHERE state IS DISTINCT FROM expected GROUP BY id")
def compatibility_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.compatible(*_required(spark, sf_dir))


@query(f"WITH {_STATES} SELECT id FROM q LEFT JOIN s USING (component) GROUP BY id HAVING bool_and(state IS NOT DISTINCT FROM expected)")
def simultaneous_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.all_hold(*_required(spark, sf_dir))


@query("""
    SELECT c_custkey AS id, 'INTENT_MISSING' AS code FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, 'INTENT_GUARANTEE_WITHOUT_INVARIANT' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, 'INVARIANT_UNKNOWN_SUBJECT' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey >= 1000 AND o_orderkey <> o_custkey AND o_orderkey NOT IN (SELECT c_custkey FROM customer)
""")
def intent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    blocks = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 2 == 0, "active").otherwise("draft").alias("lifecycle"), F.when(k % 3 == 0, "p").alias("purpose"), F.lit("").alias("summary"), F.when(k % 5 == 0, F.array(F.lit("g"))).alias("guarantees"))
    subject = F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") >= 1000), F.col("o_orderkey").cast("string"))
    invariants = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), subject.alias("subject"))
    return inv.intent_coverage(blocks, invariants, blocks.select(F.col("id").alias("node")))


@query("""
    WITH n AS (SELECT s_suppkey AS node, s_suppkey % 4 AS attempts, s_suppkey % 3 <> 0 AS idempotent, s_suppkey % 2 = 0 AS critical FROM supplier),
    p AS (SELECT DISTINCT o_custkey % 100 AS a, o_custkey % 37 AS b, o_custkey % 90 AS t FROM orders)
    SELECT a || ',' || b || ',' || t AS path, t AS target, greatest(x.attempts, 1) * greatest(y.attempts, 1) AS attempts, CASE WHEN z.critical THEN 'block' ELSE 'warning' END AS severity
    FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b JOIN n z ON z.node = t WHERE NOT z.idempotent AND (x.attempts > 1 OR y.attempts > 1)
""")
def retry_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("o_custkey")
    nodes = table(spark, sf_dir, "supplier").select(s.alias("node"), (s % 4).alias("attempts"), (s % 3 != 0).alias("idempotent"), F.lit(None).cast("boolean").alias("non_idempotent"), (s % 2 == 0).alias("critical"))
    paths = table(spark, sf_dir, "orders").select(F.array(c % 100, c % 37, c % 90).alias("path"))
    return inv.retry_risks(paths, nodes).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'INVALID_INCLUDE_TYPE' WHEN 1 THEN 'GLOB_INCLUDE_NOT_ALLOWED' WHEN 2 THEN 'INCLUDE_OUTSIDE_BLOCKS_DIR' ELSE 'INCLUDE_FILE_MISSING' END AS code FROM part WHERE p_partkey % 5 < 3 OR p_size > 20
""")
def layout_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    include = F.when(k % 5 == 1, F.concat(F.lit("blocks/*"), k)).when(k % 5 == 2, F.concat(F.lit("x/"), k)).when(k % 5 > 2, F.concat(F.lit("blocks/"), k))
    part = table(spark, sf_dir, "part").select(K, "p_size", include.alias("include"))
    found = inv.layout_findings(part.select("include").where("include is not null").union(part.select("include").where("include is null")), part.where("p_size <= 20").select(F.col("include").alias("path")), "blocks/")
    keyed = F.regexp_extract("include", r"(\d+)$", 1).cast("long")
    missing = part.where("include is null").select(K, F.lit("INVALID_INCLUDE_TYPE").alias("code"))
    return found.where("include is not null").select(keyed.alias(K), "code").unionByName(missing)


@query("""
    SELECT p_partkey AS id, 'UNKNOWN_ARTIFACT_PROFILE' AS code, 'block' AS severity FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, CASE WHEN p_size > 40 THEN 'ARTIFACT_MISSING' ELSE 'ARTIFACT_UNRESOLVED' END, CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'block' END FROM part WHERE p_size > 40 OR p_partkey % 7 = 0
""")
def artifact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    part = table(spark, sf_dir, "part")
    artifacts = part.select(k.alias("id"), F.col("p_size").cast("string").alias("path"), F.when(k % 2 == 0, F.col("p_brand")).alias("profile"), F.when(k % 3 == 0, F.lit(False)).alias("required"), (k % 7 != 0).alias("resolved"))
    files = part.where("p_size <= 40").select(F.col("p_size").cast("string").alias("path"))
    return inv.artifact_findings(artifacts, files, spark.createDataFrame([("Brand#1",), ("Brand#2",)], "profile string"))


_CODES = ["SAME_OUTCOME", "TRIVIAL_WRAPPER", "UNDECLARED_CODE", "CONFLICTING_EFFECT", "INVALID_STATUS"]


@query("""
    WITH f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'SAME_OUTCOME' WHEN 1 THEN 'TRIVIAL_WRAPPER' WHEN 2 THEN 'UNDECLARED_CODE' WHEN 3 THEN 'CONFLICTING_EFFECT' ELSE 'INVALID_STATUS' END AS code FROM events)
    SELECT code, count(*) AS n, (SELECT string_agg('m' || event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM f g WHERE g.code = f.code ORDER BY event_id LIMIT 3)) AS shown FROM f WHERE code IN ('SAME_OUTCOME', 'CONFLICTING_EFFECT') GROUP BY code
""")
def filtered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 5).cast("int"))
    findings = table(spark, sf_dir, "events").select("event_id", code.alias("code"), F.concat(F.lit("m"), "event_id").alias("message"))
    return inv.report(findings, ["event_id"], most=3, name="effect").withColumn("shown", F.array_join("shown", ","))


@query("SELECT 'no_balance' AS issue, count(*) FILTER (WHERE c_acctbal < 0) AS n FROM customer UNION ALL SELECT 'none', 0 UNION ALL SELECT 'small', count(*) FROM part WHERE p_size < 5")
def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return inv.audit({"no_balance": c.where("c_acctbal < 0"), "none": c.where(F.lit(False)), "small": table(spark, sf_dir, "part").where("p_size < 5")})
