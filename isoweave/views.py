"""The rasters and time series that the given tables hold, as DataFrames, and the same views in SQL.

tiles  each embedding is an 8 x 8 tile of variable `label`, 50 vectors a time step
obs    each event is an observation of variable `event_type` at a place derived from its user
grid   the highest price of each (return flag, month) on a 20 x 20 grid; absent cells are missing values
points customers as sampling points, some of them off the grid
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reachable

GRID = {"nx": 20, "ny": 20, "lat0": 40.0, "lon0": 0.0, "dy": 0.5, "dx": 0.5}


def shared_dir(spark: SparkSession) -> str:
    """The folder for datasets that queries write: spark.checkpoint.dir, or in a local session without one a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="isoweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a tile, its pixels an array: the form in which tiles are stored and moved."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("int").alias("variable"), F.expr("vec_id DIV 50").alias("time_id"), F.lit(6).alias("z"), (F.col("vec_id") % 64).alias("x"), F.expr("vec_id DIV 64").alias("y"), F.col("embedding").cast("array<float>").alias("pixels"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pixel; no shuffle, as each tile's row is only unfolded."""
    long = tile_arrays(spark, sf_dir).select("variable", "time_id", "z", "x", "y", F.posexplode("pixels").alias("p", "value"))
    return long.select("variable", "time_id", "z", "x", "y", F.expr("p DIV 8").alias("py"), (F.col("p") % 8).alias("px"), "value")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("variable"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "user_id", (F.col("user_id") * 17 % 160 - 80).cast("double").alias("lat"), (F.col("user_id") * 37 % 360 - 180).cast("double").alias("lon"), "value")


def present_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's cells that have a value; one shuffle, with partial maxima before it."""
    li = table(spark, sf_dir, "lineitem")
    cell = [F.col("l_returnflag").alias("variable"), F.month("l_shipdate").alias("time_id"), (F.col("l_suppkey") % 20).alias("gy"), (F.col("l_partkey") % 20).alias("gx")]
    return li.groupBy(*cell).agg(F.max("l_extendedprice").alias("value"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of all blocks, missing ones as null: each block's values gathered in a map and unfolded over the frame."""
    cells = present_cells(spark, sf_dir)
    block = cells.groupBy("variable", "time_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("gy") * 20 + F.col("gx")).alias("k"), "value"))).alias("m"))
    long = block.select("variable", "time_id", "m", F.explode(F.expr("sequence(0L, 399L)")).alias("k"))
    return long.select("variable", "time_id", F.expr("k DIV 20").alias("gy"), (F.col("k") % 20).alias("gx"), F.col("m")[F.col("k")].alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("point"), (40 + (F.col("c_custkey") * 7 % 100) / 10.0).alias("lat"), ((F.col("c_custkey") * 13 % 100) / 10.0).alias("lon"))


TILES_SQL = """tiles AS (SELECT label AS variable, vec_id // 50 AS time_id, 6 AS z, vec_id % 64 AS x, vec_id // 64 AS y, (p - 1) // 8 AS py, (p - 1) % 8 AS px, embedding[p]::FLOAT AS value
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"""
OBS_SQL = """obs AS (SELECT event_type AS variable, date_trunc('hour', ts)::TIMESTAMP AS ts, user_id, ((user_id * 17) % 160 - 80)::DOUBLE AS lat, ((user_id * 37) % 360 - 180)::DOUBLE AS lon, value FROM events)"""
CELLS_SQL = """cells AS (SELECT l_returnflag AS variable, month(l_shipdate)::INT AS time_id, l_suppkey % 20 AS gy, l_partkey % 20 AS gx, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"""
GRID_SQL = CELLS_SQL + """, grid AS (SELECT b.variable, b.time_id, k // 20 AS gy, k % 20 AS gx, c.value
  FROM (SELECT variable, time_id, unnest(range(400)) AS k FROM (SELECT DISTINCT variable, time_id FROM cells)) b
  LEFT JOIN cells c ON c.variable = b.variable AND c.time_id = b.time_id AND c.gy = b.k // 20 AND c.gx = b.k % 20)"""
POINTS_SQL = """points AS (SELECT c_custkey AS point, 40 + ((c_custkey * 7) % 100) / 10.0::DOUBLE AS lat, ((c_custkey * 13) % 100) / 10.0::DOUBLE AS lon FROM customer)"""
