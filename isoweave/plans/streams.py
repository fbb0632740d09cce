"""Queries of streams, as batches of the same plans (tests run them as streams and compare the end states)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..streaming import append
from ..views import table


@query("SELECT time_bucket(INTERVAL '2 hours', ts) AS start_, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z09 (extra): what the windowed stream ends with when nothing is late."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return append.hourly(e).select(F.col("start_").cast("timestamp_ntz").alias("start_"), "event_type", "n", F.round("total", 4).alias("total"))
