"""In-memory arrays as grid cells: regular grids given row by row, north or south first."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "variable string, unit string, ts timestamp_ntz, nx int, ny int, lat0 double, lon0 double, dy double, dx double, missing double, data array<float>"


def add_arrays(spark: SparkSession, arrays: Sequence[tuple[str, str, datetime, int, int, float, float, float, float, float | None, Sequence[float]]]) -> DataFrame:
    """Rows of ARRAYS, checked: at least 2 x 2 cells, steps that aren't zero, as many values as cells."""
    for name, _, _, nx, ny, _, _, dy, dx, _, data in arrays:
        if not name:
            raise ValueError("an array needs a variable's name")
        if nx < 2 or ny < 2 or not dx or not dy or len(data) != nx * ny:
            raise ValueError(f"{name}: a grid of 2 x 2 cells or more, with steps other than 0 and nx * ny values, is asked for")
    return spark.createDataFrame([tuple(list(a[:-1]) + [[float(v) for v in a[-1]]]) for a in arrays], ARRAYS)


def cells(arrays: DataFrame) -> DataFrame:
    """One row a cell, missing values as null; negative steps are turned so that rows go north and columns east."""
    long = arrays.select("variable", "ts", "nx", "ny", "lat0", "lon0", "dy", "dx", "missing", F.posexplode("data").alias("p", "raw"))
    row, col = F.expr("p DIV nx"), F.col("p") % F.col("nx")
    gy = F.when(F.col("dy") < 0, F.col("ny") - 1 - row).otherwise(row)
    gx = F.when(F.col("dx") < 0, F.col("nx") - 1 - col).otherwise(col)
    value = F.nullif(F.nanvl(F.col("raw"), F.lit(None).cast("float")), F.col("missing").cast("float"))
    return long.select("variable", "ts", gy.cast("long").alias("gy"), gx.cast("long").alias("gx"), (F.col("lat0") + row * F.col("dy")).alias("lat"), (F.col("lon0") + col * F.col("dx")).alias("lon"), value.alias("value"))


def bounds(arrays: DataFrame) -> DataFrame:
    """west, south, east, north over all grids."""
    far = lambda o, n, d: F.col(o) + (F.col(n) - 1) * F.col(d)
    ends: list[Column] = [F.min(F.least("lon0", far("lon0", "nx", "dx"))).alias("west"), F.min(F.least("lat0", far("lat0", "ny", "dy"))).alias("south"), F.max(F.greatest("lon0", far("lon0", "nx", "dx"))).alias("east"), F.max(F.greatest("lat0", far("lat0", "ny", "dy"))).alias("north")]
    return arrays.agg(*ends)
