"""The event table read as log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.model import label, with_time


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per event; a third of the users has no tenant label."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").otherwise("info")
    tenant = F.when(F.col("user_id") % 3 == 0, "team-a").when(F.col("user_id") % 3 == 1, "team-b")
    labels = F.array(label("job", F.col("event_type")), label("level", level))
    message = F.concat_ws(" ", "event_type", F.concat(F.lit("user="), F.col("user_id").cast("string")), "props")
    rows = e.select(
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        message.alias("message"),
        message.alias("raw_line"),
        F.when(tenant.isNull(), labels).otherwise(F.concat(labels, F.array(label("tenant", tenant)))).alias("labels"),
    )
    return with_time(rows)


#: The same in DuckDB; labels are columns job, level, tenant (null: no such label).
EVENTS_SQL = """e AS (
  SELECT event_id AS seq, epoch_ns(ts) AS ts_ns, ts::DATE AS day, 'svc-' || (user_id % 5)::VARCHAR AS source,
    concat_ws(' ', event_type, 'user=' || user_id::VARCHAR, props) AS message, event_type AS job,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' ELSE 'info' END AS level,
    CASE user_id % 3 WHEN 0 THEN 'team-a' WHEN 1 THEN 'team-b' END AS tenant
  FROM events)"""
