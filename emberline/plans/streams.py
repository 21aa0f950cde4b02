"""Streaming queries, drained over the events table and compared with their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.registry import query
from emberline.streaming import pipelines


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # event time with a zone; the session's zone is UTC
    return pipelines.events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST01, ST02, ST08: each key once; all data lies within the watermark."""
    return pipelines.run(pipelines.dedup(_events(spark, sf_dir), ["user_id", "event_type"], "at", "60 days").select("user_id", "event_type"))


@query("SELECT * FROM (SELECT event_type, to_timestamp(epoch(time_bucket(INTERVAL 10 MINUTE, ts)) - 600 * k)::TIMESTAMP AS started, count(*) AS n_reports FROM events, range(3) r(k) GROUP BY ALL) WHERE started + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST09: reports per sliding half hour, each once the watermark, an hour behind, has passed it."""
    s = pipelines.bursts(_events(spark, sf_dir), ["event_type"], "at").select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), "n_reports")
    return pipelines.run(s)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n_events FROM s GROUP BY user_id, n HAVING ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST03: sessions that end with six hours of silence, each once the watermark has passed it."""
    s = pipelines.sessions(_events(spark, sf_dir), "user_id", "at", "6 hours")
    return pipelines.run(s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n_events"))


@query()
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST05: accepted events under a sliding limit; a test holds it against the fold."""
    return pipelines.run(pipelines.throttle(_events(spark, sf_dir).withColumn("k", F.col("user_id") % 40), "k", "at", 72_000, 3, "60 days"))
