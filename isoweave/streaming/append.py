"""Streams of observations: windows with late data, and appends of tiles to a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import dataset


def hourly(events: DataFrame, delay: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """Counts and totals by type in tumbling windows; what comes later than the watermark is dropped."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", delay).alias("w"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of users that end after a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_"), F.col("w.end").alias("end_"), "n")


def append_stream(tiles: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch as one append; what is late or there already is set aside, so a batch that is run again adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.limit(1).count():
            return
        if dataset.generations(batch.sparkSession, path):
            dataset.append(batch, path, late="drop")
        else:
            dataset.write(batch, path)

    return tiles.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
