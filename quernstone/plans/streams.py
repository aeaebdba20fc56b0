"""Queries that run a stream over events to its end and read what it has left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.publish import work_folder
from quernstone.streaming import watch

from .registry import query

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
GAP_MS = 6 * 3600 * 1000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.read_changes(spark, f"{sf_dir}/events.parquet", EVENTS, files_per_batch=None)


@query(f"""
    WITH e AS (SELECT user_id, event_type, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= {GAP_MS * 1000} THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM e)
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, part
""")
def debounced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a user's events without a pause of more than six hours."""
    folder = work_folder(spark)
    sets = watch.change_sets(_events(spark, sf_dir), "user_id", "event_type", "ts", gap_ms=GAP_MS, drain=True)
    sets.writeStream.format("parquet").option("path", f"{folder}/sets").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(sets.schema).parquet(f"{folder}/sets")
    return out.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n", F.array_join("paths", ",").alias("paths"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def published_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of events, a third of which come twice; published by a run that ends, and by another that finds nothing new."""
    folder = work_folder(spark)
    for _ in range(2):
        twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
        watch.publish_outbox(twice, f"{folder}/ledger", f"{folder}/checkpoint", created="ts", delay="365 days").awaitTermination()
    return watch.published(spark, f"{folder}/ledger", EVENTS).select("event_id", "user_id", "event_type", "value")
