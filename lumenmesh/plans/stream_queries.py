"""Streams over the event table, run to their end once, each beside the SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmesh.operators.graph import shared_folder
from lumenmesh.streaming import logs

FILES = T.StructType([T.StructField(f.name, T.TimestampNTZType() if f.name == "ts" else f.dataType) for f in logs.EVENT])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_events(spark, f"{sf_dir}/events.parquet*", schema=FILES).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _outcome(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    at = _folder(spark)
    logs.run_once(stream, logs.idempotent_sink(f"{at}/out"), f"{at}/checkpoint", mode)
    return spark.read.parquet(f"{at}/out")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _outcome(spark, logs.windowed(_events(spark, sf_dir), "1 day", late="400 days"), "update")
    return out.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max("n").alias("n"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _outcome(spark, logs.progress_states(_events(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max_by("state", "updates").alias("state"), F.max("percent").alias("percent"), F.max("updates").alias("updates"))


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _events(spark, sf_dir)
    out = _outcome(spark, logs.deduplicated(live.unionByName(live), "400 days"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {"stream_daily_counts": daily_counts, "stream_progress": progress, "stream_once": once}


def oracle_sql() -> dict:
    return {
        "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "stream_progress": "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value = 0) THEN 'FAILED' WHEN max(value) >= 100 THEN 'COMPLETE' ELSE 'RUNNING' END AS state, max(least(100, greatest(0, value))) AS percent, count(*) AS updates FROM events GROUP BY 1",
        "stream_once": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    }
