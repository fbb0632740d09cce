"""From source grids to a dataset of tiles: every tile of every zoom is sampled from the source itself.

A grid stays one row with its values as an array; its tiles are unfolded from its box, and the pixels of a tile are
bilinear samples taken within that row. Nothing is joined or shuffled before the tiles are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addressing as A
from . import dataset


def bilinear(fx: Column, fy: Column, nx: Column, ny: Column, cells: str) -> Column:
    """The value between four of the row's cells (an array, null for missing); upper edges count, a missing one of the four makes it missing."""
    x0, y0 = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    u, v = fx - x0, fy - y0
    x1, y1 = F.least(x0 + 1, nx - 1), F.least(y0 + 1, ny - 1)
    at = lambda row, col: F.get(cells, row * nx + col)
    value = (1 - u) * (1 - v) * at(y0, x0) + u * (1 - v) * at(y0, x1) + (1 - u) * v * at(y1, x0) + u * v * at(y1, x1)
    return F.when(fx.between(0, nx - 1) & fy.between(0, ny - 1), value)


def tiles_of(arrays: DataFrame, zooms: range, size: int = 8) -> DataFrame:
    """variable, ts, z, x, y, pixels (array<double>, null for missing) of all tiles that hold a value. arrays: rows of sources.arrays.ARRAYS."""
    far = lambda o, n, d: F.col(o) + (F.col(n) - 1) * F.col(d)
    g = arrays.withColumns({"north": F.greatest("lat0", far("lat0", "ny", "dy")), "south": F.least("lat0", far("lat0", "ny", "dy")), "west": F.least("lon0", far("lon0", "nx", "dx")), "east": F.greatest("lon0", far("lon0", "nx", "dx"))})
    # missing values are sought once a cell, not once a pixel
    g = g.withColumn("cells", F.transform("data", lambda v: F.when(~F.isnan(v) & ~v.eqNullSafe(F.col("missing").cast("float")), v.cast("double")))).drop("data")
    g = g.withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    x0, x1, y0, y1 = A.tile_span(*(F.col(c) for c in ("z", "west", "south", "east", "north")))
    for name, a, b in (("x", x0, x1), ("y", y0, y1)):
        g = g.withColumn(name, F.explode(F.sequence(a.cast("long"), b.cast("long"))))
    # places on the grid of a tile's columns and rows
    side = F.sequence(F.lit(0), F.lit(size - 1))
    g = g.withColumn("fx", F.transform(side, lambda k: (A.pixel_lon(F.col("z"), F.col("x"), k, size) - F.col("lon0")) / F.col("dx")))
    g = g.withColumn("fy", F.transform(side, lambda k: (A.pixel_lat(F.col("z"), F.col("y"), k, size) - F.col("lat0")) / F.col("dy")))
    pixel = lambda k: bilinear(F.get("fx", k % size), F.get("fy", F.floor(k / size).cast("int")), F.col("nx"), F.col("ny"), "cells")
    out = g.select("variable", "ts", "z", "x", "y", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), pixel).alias("pixels"))
    # a row number in the test keeps the filter above the samples, which it would else take twice
    held = F.exists("pixels", lambda v: v.isNotNull()) & (F.monotonically_increasing_id() >= 0)
    return out.withColumn("held", held).filter("held").drop("held")


def numbered(tiles: DataFrame, arrays: DataFrame) -> DataFrame:
    """tiles with time_id, the place of ts on the sorted axis of the source's times. The axis is a dimension and goes along as one value."""
    axis = arrays.agg(F.array_sort(F.collect_set("ts"))).scalar()
    return tiles.withColumn("time_id", (F.array_position(axis, F.col("ts")) - 1).cast("int")).drop("ts")


def encode(arrays: DataFrame, path: str, zooms: range, size: int = 8) -> None:
    """Grids as a new dataset of tiles."""
    dataset.write(numbered(tiles_of(arrays, zooms, size), arrays), path)
