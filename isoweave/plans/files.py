"""Queries through codecs and arrays; the rows of those without SQL are tested in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codecs import encoded
from ..registry import query
from ..views import TILES_SQL, tile_arrays


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tile_arrays(spark, sf_dir)
    return t.select("variable", "time_id", "x", "y", (F.col("variable") % 2).cast("int").alias("dtype"), F.transform("pixels", lambda v: F.floor(v.cast("double") * 100 + 0.5).cast("int") + 128).alias("codes"))


@query()
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest blob of each tile, its codec and checksum, decoded again."""
    return encoded(codes(spark, sf_dir), ["variable", "time_id", "x", "y"]).drop("blob")


@query(f"WITH {TILES_SQL} SELECT variable, count(DISTINCT (time_id, x, y))::BIGINT AS tiles, sum(floor(value::DOUBLE * 100 + 0.5)::BIGINT + 128)::BIGINT AS total, bool_and(floor(value::DOUBLE * 100 + 0.5) + 128 BETWEEN 0 AND 65535) AS exact FROM tiles GROUP BY variable")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q08: the sum of a variable's codes as decoded from their blobs, and whether all tiles come back exactly."""
    return encoded(codes(spark, sf_dir), ["variable", "time_id", "x", "y"]).groupBy("variable").agg(F.count("*").alias("tiles"), F.sum("total").alias("total"), F.every("exact").alias("exact"))
