"""Streaming aggregates in their batch form, which must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.streaming import pipelines


def tumbling_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"))
    t = pipelines.tumbling_health(events, window="1 hour", seconds=3600.0, least_hz=0.0035)
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("hz", 6).alias("hz"), "low")


TUMBLING_SQL = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(round(count(*) / 3600, 4), 6) AS hz, round(count(*) / 3600, 4) < 0.0035 AS low FROM events GROUP BY 1"""

QUERIES = {"tumbling_health": (tumbling_health, TUMBLING_SQL)}
