"""Queries of duplicate profiles, effects and cache checks, over evidence made from parts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import effects, profiles

from .registry import query, table

#: Per remainder of the key by ten: the fields of evidence that are set, as SQL.
_CASES: list[dict[str, str]] = [
    {"kind": "'function'", "constants": "array('conf/app.yaml')", "action": "'write'", "resource": "'file'", "target": "'x'", "outcome_key": "'k'"},
    {"kind": "'function'", "constants": "array('/items')", "decorators": "array('app.get')"},
    {"kind": "'method'", "action": "'send'", "resource": "'http_api'", "target": "p_brand", "outcome_key": "'k'", "calls": "array('post')"},
    {"kind": "'function'", "wrapper": "true", "wrapper_target": "'core.run'"},
    {"kind": "'method'", "wrapper": "true", "wrapper_target": "'core.go'", "calls": "array('core.go')", "child_keys": "array('w', 'ck')", "child_strengths": "array('weak', 'strong')"},
    {"kind": "'class'", "interface": "'i5'", "resolved": "array('a')", "child_keys": "array('ck')", "child_strengths": "array('strong')"},
    {"kind": "'class'", "child_keys": "array('ck')", "child_strengths": "array('strong')", "resolved": "array('a', 'b')"},
    {"kind": "'function'", "resolved": "array('r1')", "imports": "array('json')", "interface": "'i7'"},
    {"kind": "'function'", "return_hash": "'abc'"},
    {"kind": "'class'", "body_hash": "CASE WHEN p_size % 2 = 0 THEN 'h' || p_brand END"},
]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    def field(name: str, kind: str) -> Column:
        cases = " ".join(f"WHEN {i} THEN {c[name]}" for i, c in enumerate(_CASES) if name in c)
        return F.expr(f"CAST({f'CASE p_partkey % 10 {cases} END' if cases else 'NULL'} AS {kind})").alias(name)

    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", *[field(n, k) for n, k in profiles.EVIDENCE.items() if n != "symbol"], F.concat(F.lit("s"), "p_partkey").alias("symbol"))


_KEYS = """
    k AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'write|file|conf/app.yaml' WHEN 1 THEN 'route|http_endpoint|GET:/items' WHEN 2 THEN 'send|http_api|' || p_brand || '|*' WHEN 3 THEN 'wrapper|call|core.run'
            WHEN 4 THEN 'delegate|core.go|child:ck' WHEN 5 THEN 'child|ck|interface:i5' WHEN 6 THEN 'child|ck' WHEN 7 THEN 'composite|calls:r1|imports:json|interface:i7' WHEN 8 THEN 'return|abc'
            ELSE CASE WHEN p_size % 2 = 0 THEN 'structure|h' || p_brand END END AS duplicate_key FROM part)
"""


@query(f"""
    WITH {_KEYS} SELECT p_partkey, duplicate_key, substr(sha256(duplicate_key), 1, 16) AS duplicate_hash,
      CASE WHEN duplicate_key IS NULL THEN 'unknown' WHEN p_partkey % 10 < 5 THEN 'strong' ELSE 'weak' END AS strength FROM k
""")
def duplicate_key_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.duplicate_keys(_evidence(spark, sf_dir)).select("p_partkey", "keys.duplicate_key", "keys.duplicate_hash", "keys.strength")


@query("""
    SELECT p_partkey, 'access' AS action, 'file' AS resource, '/items' AS target, 'medium' AS confidence FROM part WHERE p_partkey % 10 = 1
    UNION ALL SELECT p_partkey, 'write', 'file', 'conf/app.yaml', 'high' FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT p_partkey, 'route', 'http_endpoint', 'GET:/items', 'high' FROM part WHERE p_partkey % 10 = 1
    UNION ALL SELECT p_partkey, 'route', 'http_endpoint', '/items', 'medium' FROM part WHERE p_partkey % 10 = 1
""")
def domain_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evidence(spark, sf_dir).select("p_partkey", F.explode(profiles.signals()).alias("s"))
    return found.select("p_partkey", "s.action", "s.resource", "s.target", "s.confidence")


@query("""
    WITH b AS (SELECT p_brand || p_type AS h, CASE WHEN p_type = 'ECONOMY' THEN 'strong' ELSE 'weak' END AS s, count(*) AS n, p_brand FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2, 4)
    SELECT h AS duplicate_hash, s AS strength, n, CASE WHEN s = 'strong' THEN 'DUPLICATE_ACTIVE_PROFILE' ELSE 'DUPLICATE_PROFILE_REVIEW' END AS code FROM b WHERE n > 1 AND p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')
""")
def duplicate_profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, brand, h = table(spark, sf_dir, "part"), F.col("p_brand"), F.concat("p_brand", "p_type")
    key = F.col("p_partkey").cast("string")
    symbol = F.when(brand == "Brand#2", F.concat(F.lit("K"), key, F.lit(".go"))).otherwise(F.concat(F.lit("f"), key))
    blocks = part.select(key.alias("id"), F.when(F.col("p_partkey") % 3 != 0, "active").otherwise("draft").alias("status"), symbol.alias("symbol"), F.when(brand == "Brand#3", h).alias("purpose"), h.alias("duplicate_hash"), F.when(F.col("p_type") == "ECONOMY", "strong").otherwise("weak").alias("strength"))
    return profiles.duplicate_findings(blocks, allowed=part.where(brand == "Brand#1").select(h.alias("duplicate_hash")).distinct())


@query("""
    WITH p AS (SELECT p_partkey, substr(sha256(p_name || '|' || substr(sha256(p_brand || '|' || p_type), 1, 16)), 1, 16) AS local FROM part),
    d AS (SELECT l_orderkey, string_agg(local, '|' ORDER BY local) AS deps FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN p ON p_partkey = l_partkey GROUP BY 1)
    SELECT l_orderkey, substr(sha256(deps), 1, 16) AS dependency_hash FROM d
""")
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = profiles.short_hash(F.concat_ws("|", "p_brand", "p_type"))
    units = table(spark, sf_dir, "part").select("p_partkey", profiles.source_fingerprint([F.col("p_name"), listed]).alias("local"))
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("child")).distinct()
    return profiles.dependency_fingerprints(units.withColumnRenamed("p_partkey", "unit"), "unit", calls.withColumnRenamed("l_orderkey", "unit"), ["local"]).withColumnRenamed("unit", "l_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND (c_custkey % 5 <> 0 OR c_mktsegment = 'BUILDING')")
def reusable_cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    cached = c.where(k % 4 != 0).select("c_custkey", "c_mktsegment", F.lit(None).cast("int").alias("version"))
    now = c.select("c_custkey", F.when(k % 5 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.lit(None).cast("int").alias("version"))
    return profiles.reusable(cached, now, "c_custkey", ["c_mktsegment", "version"]).select("c_custkey")


_CALLS = ["session.add", "requests.get", "os.remove", "print", "redis.set", "cursor.execute", "midi.note", "json.dumps", "model.fit", "findings.append", "vendor.sync", "logger.info"]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _CALLS))
    e, i = table(spark, sf_dir, "events"), F.col("event_id").cast("int")
    none = F.array().cast("array<string>")
    return e.select(
        "event_id", F.array(F.get(names, i % 12), F.get(names, i % 12)).alias("calls"), F.when(i % 12 == 5, F.array(F.lit("INSERT  INTO t1, t2"))).when(i % 12 == 9, F.array(F.lit("LOW_STOCK"))).otherwise(none).alias("strings"),
        F.when(i % 5 == 0, F.array(F.lit("a + b"))).alias("returns"), F.when(i % 7 == 0, F.array(F.lit("ValueError"))).alias("raises"), F.when(i % 6 == 1, F.array(F.lit("self.x"), F.lit("y"))).alias("mutations"),
    )


@query("""
    WITH e AS (SELECT event_id, event_id % 12 AS c FROM events)
    SELECT event_id, CASE c WHEN 0 THEN 'insert' WHEN 1 THEN 'send' WHEN 2 THEN 'delete' WHEN 3 THEN 'render' WHEN 4 THEN 'write' WHEN 5 THEN 'insert' WHEN 6 THEN 'send' WHEN 7 THEN 'serialize' WHEN 8 THEN 'train' WHEN 9 THEN 'emit' ELSE 'emit' END AS action,
           CASE c WHEN 0 THEN 'database' WHEN 1 THEN 'http_api' WHEN 2 THEN 'file' WHEN 3 THEN 'terminal' WHEN 4 THEN 'cache' WHEN 5 THEN 'database' WHEN 6 THEN 'midi_event' WHEN 7 THEN 'json' WHEN 8 THEN 'model' WHEN 9 THEN 'finding' ELSE 'log' END AS resource,
           CASE c WHEN 0 THEN 'session.add' WHEN 1 THEN 'get' WHEN 2 THEN 'os.remove' WHEN 3 THEN 'print' WHEN 4 THEN 'redis.set' WHEN 5 THEN 't1' WHEN 6 THEN 'midi.note' WHEN 7 THEN 'json' WHEN 8 THEN 'model.fit' WHEN 9 THEN 'LOW_STOCK' ELSE 'logger.info' END AS target, 'high' AS confidence
    FROM e WHERE c <> 10
    UNION ALL SELECT event_id, 'return', 'value', substr(sha256('a + b'), 1, 12), 'medium' FROM e WHERE event_id % 5 = 0
    UNION ALL SELECT event_id, 'raise', 'exception', 'ValueError', 'high' FROM e WHERE event_id % 7 = 0
    UNION ALL SELECT event_id, 'update', 'memory_state', 'self.x', 'high' FROM e WHERE event_id % 6 = 1
""")
def inferred_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.infer_effects(_units(spark, sf_dir), "event_id").select("event_id", "action", "resource", "target", "confidence")


@query("SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'session.add' WHEN 2 THEN 'os.remove' WHEN 6 THEN 'midi.note' WHEN 10 THEN 'vendor.sync' END AS calls FROM events WHERE event_id % 12 IN (0, 2, 6, 10)")
def unclassified_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _units(spark, sf_dir).select("event_id", effects.unclassified_calls(F.col("calls"), ["print"]).alias("u"))
    return got.where(F.size("u") > 0).select("event_id", F.array_join("u", ",").alias("calls"))
