"""Scalar functions over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import scalars as s

from .registry import query, table


@query("SELECT event_id, replace(props, ' ', '') AS canonical, sha256(replace(props, ' ', '')) AS digest FROM events")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.canonical_json(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", c.alias("canonical"), s.digest(c).alias("digest"))


@query("SELECT p_partkey, left(sha256(p_brand || '|' || p_type), 16) AS h, CASE WHEN length(p_name) > 0 THEN left(sha256(p_name), 12) END AS short FROM part")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.tuple_hash(F.col("p_brand"), F.col("p_type")).alias("h"), s.short_hash(F.col("p_name"), 12).alias("short"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(p_brand || ' / ' || p_type, '[\\s/]+', '_', 'g'), '[^A-Za-z0-9_-]', '', 'g')) AS shard FROM part")
def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.shard_name(F.concat_ws(" / ", "p_brand", "p_type")).alias("shard"))


@query("SELECT c_custkey, string_split(lower(c_mktsegment) || ' of ' || c_nationkey, ' ') AS tokens FROM customer")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", s.plain_tokens(F.concat(F.col("c_mktsegment"), F.lit("-Of."), F.col("c_nationkey").cast("string"))).alias("tokens"))


@query("SELECT c_custkey, 'new/' || c_nationkey || '/a.py' AS path FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, 'older/' || c_nationkey || '/a.py' FROM customer WHERE c_nationkey >= 5")
def moved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.when(F.col("c_nationkey") < 5, "old").otherwise("older")
    return table(spark, sf_dir, "customer").select("c_custkey", s.moved_path(F.concat_ws("/", root, F.col("c_nationkey").cast("string"), F.lit("a.py")), "old", "new").alias("path"))


@query("SELECT event_id, strftime(ts, '%Y/%m') AS folder FROM events")
def event_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", s.year_month(F.col("ts")).alias("folder"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(CAST(c_acctbal AS INTEGER) AS VARCHAR) AS cell FROM customer WHERE c_acctbal = CAST(c_acctbal AS INTEGER) OR TRUE AND CAST(c_acctbal AS INTEGER) <> 0")
def spreadsheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.rint("c_acctbal").cast("int")
    return table(spark, sf_dir, "customer").where((F.col("c_acctbal") == whole) | (whole != 0)).select("c_custkey", s.spreadsheet_safe(whole.cast("string")).alias("cell"))


@query("""
    SELECT c_custkey, 'intent' AS changed, 1 AS n_before FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1
    UNION ALL SELECT c_custkey, 'intent,notes', 2 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'notes', 1 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0
""")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    old = F.create_map(F.lit("intent"), F.lit("a"), F.lit("notes"), F.lit("b"), F.lit("$rev"), F.lit("1"))
    new = F.map_filter(F.create_map(F.lit("intent"), F.when(k % 3 == 0, "x").otherwise("a"), F.lit("notes"), F.when(k % 2 != 0, "b"), F.lit("$rev"), F.lit("2")), lambda _, v: v.isNotNull())
    change = s.field_level_change(old, new, [])
    out = table(spark, sf_dir, "customer").select(k, s.changed_keys(old, new).alias("keys"), change.alias("c")).where(F.size("keys") > 0)
    return out.select("c_custkey", F.array_join("keys", ",").alias("changed"), F.size("c.before").alias("n_before"))
