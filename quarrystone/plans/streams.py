"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.plans.base import query
from quarrystone.streaming import jobs


@query()
def pair_pool_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.open_stream(spark, f"{sf_dir}/embeddings.parquet")
    return jobs.run_to_end(jobs.pair_pool(rows, "vec_id", 4, 32, 7), "append", "pool")


@query("SELECT event_type, t.v AS best, t.i AS best_at FROM (SELECT event_type, max({'v': value, 'i': event_id}) AS t FROM events GROUP BY event_type)")
def best_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = jobs.open_stream(spark, f"{sf_dir}/events.parquet")
    return jobs.run_to_end(jobs.best_so_far(events, "event_type", "value", "event_id"), "complete", "best")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = jobs.open_stream(spark, f"{sf_dir}/events.parquet")
    out = jobs.run_to_end(jobs.tumbling_counts(events, "ts", "event_type", "1 hour", "1 day"), "complete", "tumbling")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = jobs.open_stream(spark, f"{sf_dir}/events.parquet")
    out = jobs.run_to_end(jobs.sessions(events, "ts", "user_id", "30 minutes", "1 day"), "complete", "sessions")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")
