"""Queries that read a table as a stream and give what the stream leaves behind; chunks and tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import chunks
from brindle.plans.base import Registry
from brindle.sources.tables import table
from brindle.streaming import jobs

register = Registry()


@register("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind and day, kept as a running total."""
    stream = jobs.stream_table(spark, f"{d}/events.parquet")
    return jobs.collect_updates(jobs.daily_totals(stream, "ts", "event_type", "value"), ["event_type", "day"]).withColumn("total", F.round("total", 4))


@register(
    """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, n"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users from a stream of events."""
    stream = jobs.stream_table(spark, f"{d}/events.parquet")
    found = jobs.collect_updates(jobs.sessions(stream, "ts", "user_id"), ["user_id", "start"], "complete")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@register(
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS category, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error'),
r AS (SELECT category, min(at_us) AS at_us FROM e GROUP BY 1 UNION ALL SELECT r.category, min(e.at_us) AS at_us FROM r JOIN e ON e.category = r.category AND e.at_us >= r.at_us + 300000000 GROUP BY r.category)
SELECT category, at_us FROM r"""
)
def stream_rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Error events of each user at most every five minutes."""
    stream = jobs.stream_table(spark, f"{d}/events.parquet").where("event_type = 'error'")
    return jobs.collect_updates(jobs.rate_limited(stream, "ts", "user_id").withColumnRenamed("at", "at_us"), ["category", "at_us"], "complete")


@register(
    """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, epoch_us(max(ts)) AS at_us, max_by(event_type, ts) AS action FROM s GROUP BY user_id, n"""
)
def stream_debounced(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each burst, bursts being an hour apart."""
    stream = jobs.stream_table(spark, f"{d}/events.parquet")
    found = jobs.collect_updates(jobs.debounced(stream, "ts", "user_id", "event_type", "60 minutes"), ["user_id", "at"], "complete")
    return found.select("user_id", F.unix_micros("at").alias("at_us"), "action")


@register()
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into titled chunks of at most 2,000 characters."""
    return chunks.chunk(table(spark, d, "documents", "doc_id", "text"), F.col("doc_id"), F.col("text"), 2000, 200)


@register()
def evened_tables(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their pipe tables evened out."""
    return chunks.even_out_tables(table(spark, d, "documents", "doc_id", "text").where("text like '%|%'"), "text")
