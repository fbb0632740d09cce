"""Queries at points: bilinear and bicubic samples, series and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..views import CELLS_SQL, GRID, GRID_SQL, OBS_SQL, POINTS_SQL, grid, obs, points, present_cells

CELL = ["variable", "time_id"]


def grid_position(lat: Column, lon: Column, g: dict) -> tuple[Column, Column]:
    return (lon - g["lon0"]) / g["dx"], (lat - g["lat0"]) / g["dy"]


def on_grid(x: Column, y: Column, g: dict) -> Column:
    """Upper edges count; longitudes don't wrap."""
    return x.between(0, g["nx"] - 1) & y.between(0, g["ny"] - 1)


def corners(pts: DataFrame, g: dict, reach: range = range(2)) -> DataFrame:
    """A row for each of a point's neighbours, with its weights' fractions: what is then joined by equality on (gx, gy)."""
    x, y = grid_position(F.col("lat"), F.col("lon"), g)
    p = pts.withColumns({"fx": x, "fy": y}).filter(on_grid(F.col("fx"), F.col("fy"), g))
    p = p.withColumns({"x0": F.floor("fx"), "y0": F.floor("fy")}).withColumns({"u": F.col("fx") - F.col("x0"), "v": F.col("fy") - F.col("y0")})
    offs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in reach for i in reach))
    p = p.withColumn("o", F.explode(offs))
    return p.withColumns({"gx": F.least(F.col("x0") + F.col("o.i"), F.lit(g["nx"] - 1)), "gy": F.least(F.col("y0") + F.col("o.j"), F.lit(g["ny"] - 1))})


def sampled(pts: DataFrame, cells: DataFrame, g: dict) -> DataFrame:
    """point, variable, time_id, value: bilinear; null if any neighbour is missing. Cells that are missing have no row in `cells`."""
    c = corners(pts, g)
    w = F.when(F.col("o.i") == 1, F.col("u")).otherwise(1 - F.col("u")) * F.when(F.col("o.j") == 1, F.col("v")).otherwise(1 - F.col("v"))
    hit = c.select("point", "gx", "gy", w.alias("w")).join(cells, ["gx", "gy"])
    return hit.groupBy("point", *CELL).agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("value"))


def every_block(pts: DataFrame, cells: DataFrame) -> DataFrame:
    """Points by blocks. The blocks are few: (variable, time) pairs, not cells; they go along as one value, so nothing is joined."""
    blocks = cells.select(*CELL).distinct().agg(F.collect_list(F.struct(*CELL))).scalar()
    return pts.select("point", F.explode(blocks).alias("b")).select("point", "b.*")


_FRAC = "p AS (SELECT point, lat, lon, lon / 0.5::DOUBLE AS fx, (lat - 40) / 0.5::DOUBLE AS fy FROM points), q AS (SELECT *, floor(fx) AS x0, floor(fy) AS y0 FROM p WHERE fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19)"
_CORNER = "k AS (SELECT q.*, i, j, (CASE WHEN i = 1 THEN fx - x0 ELSE 1 - (fx - x0) END) * (CASE WHEN j = 1 THEN fy - y0 ELSE 1 - (fy - y0) END) AS w, least(x0 + i, 19)::BIGINT AS gx, least(y0 + j, 19)::BIGINT AS gy FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))"
_SAMPLE = f"WITH {GRID_SQL}, {POINTS_SQL}, {_FRAC}, {_CORNER}, s AS (SELECT point, g.variable, g.time_id, CASE WHEN count(g.value) = 4 THEN sum(w * g.value) END AS value FROM k JOIN grid g USING (gx, gy) GROUP BY ALL)"


@query(_SAMPLE + " SELECT point, variable, time_id, round(value, 4) AS value FROM s")
def sample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples at points on the grid; a missing neighbour makes a missing sample."""
    cells = present_cells(spark, sf_dir)
    pts = points(spark, sf_dir)
    inside = pts.withColumns(dict(zip(("fx", "fy"), grid_position(F.col("lat"), F.col("lon"), GRID)))).filter(on_grid(F.col("fx"), F.col("fy"), GRID)).select("point")
    out = every_block(inside, cells).join(sampled(pts, cells, GRID), ["point", *CELL], "left")
    return out.select("point", *CELL, F.round("value", 4).alias("value"))


@query(_SAMPLE + " SELECT p.point, b.variable, b.time_id, round(s.value, 4) AS value FROM points p CROSS JOIN (SELECT DISTINCT variable, time_id FROM cells) b LEFT JOIN s ON s.point = p.point AND s.variable = b.variable AND s.time_id = b.time_id")
def samples_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many points by all blocks; points off the grid are missing everywhere."""
    cells = present_cells(spark, sf_dir)
    pts = points(spark, sf_dir)
    return every_block(pts, cells).join(sampled(pts, cells, GRID), ["point", *CELL], "left").select("point", *CELL, F.round("value", 4).alias("value"))


@query(
    _SAMPLE
    + ", d AS (SELECT point, variable, time_id, count(g.value)::BIGINT AS neighbours, min(gx)::BIGINT AS x0, max(gx)::BIGINT AS x1, min(gy)::BIGINT AS y0, max(gy)::BIGINT AS y1, count(DISTINCT (gx // 8, gy // 8))::BIGINT AS chunks, arg_max(g.value, (w * 1e6)::BIGINT * 10 + (3 - i - 2 * j)) AS nearest FROM k JOIN grid g USING (gx, gy) GROUP BY ALL) SELECT point, variable, time_id, neighbours, x0, x1, y0, y1, chunks, CASE WHEN neighbours = 4 THEN round(nearest, 4) END AS nearest FROM d"
)
def sample_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sample touches: neighbours, chunks of 8 x 8 and the nearest value."""
    g = grid(spark, sf_dir)
    c = corners(points(spark, sf_dir), GRID)
    w = F.when(F.col("o.i") == 1, F.col("u")).otherwise(1 - F.col("u")) * F.when(F.col("o.j") == 1, F.col("v")).otherwise(1 - F.col("v"))
    rank = F.round(w * 1e6).cast("long") * 10 + (3 - F.col("o.i") - 2 * F.col("o.j"))
    d = c.select("point", "gx", "gy", rank.alias("rank")).join(g, ["gx", "gy"]).groupBy("point", *CELL)
    chunk = F.expr("(gx DIV 8) * 1000 + gy DIV 8")
    d = d.agg(F.count("value").alias("neighbours"), F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"), F.count_distinct(chunk).alias("chunks"), F.max_by("value", "rank").alias("nearest"))
    return d.select("point", *CELL, "neighbours", "x0", "x1", "y0", "y1", "chunks", F.when(F.col("neighbours") == 4, F.round("nearest", 4)).alias("nearest"))


_SERIES = f"WITH {OBS_SQL}, h AS (SELECT variable, ts, round(avg(value), 6) AS value FROM obs GROUP BY ALL), times AS (SELECT DISTINCT ts FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 00:00:00'), vars AS (SELECT DISTINCT variable FROM obs)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).groupBy("variable", "ts").agg(F.round(F.avg("value"), 6).alias("value"))


@query(_SERIES + " SELECT v.variable, t.ts, h.value FROM vars v CROSS JOIN times t LEFT JOIN h ON h.variable = v.variable AND h.ts = t.ts")
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of every variable over a closed time range, gaps as nulls. Times and variables are dimensions."""
    o = obs(spark, sf_dir)
    within = F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-07 00:00:00'"))
    times = o.select("ts").filter(within).distinct()
    names = o.agg(F.collect_set("variable")).scalar()
    axis = times.select(F.explode(names).alias("variable"), "ts")
    return axis.join(hourly(spark, sf_dir).filter(within), ["variable", "ts"], "left")


@query(_SERIES + ", one AS (SELECT variable, value FROM h WHERE ts = TIMESTAMP '2024-01-06 12:00:00') SELECT v.variable, one.value FROM vars v LEFT JOIN one USING (variable)")
def value_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variables at one time."""
    one = hourly(spark, sf_dir).filter(F.col("ts") == F.expr("TIMESTAMP_NTZ '2024-01-06 12:00:00'")).select("variable", "value")
    return obs(spark, sf_dir).select("variable").distinct().join(one, "variable", "left")


@query(
    f"WITH {OBS_SQL}, axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS time_id FROM (SELECT DISTINCT ts FROM obs)), m AS (SELECT count(*) - 1 AS last FROM axis), v AS (SELECT o.variable, a.time_id, avg(o.value) AS value FROM obs o JOIN axis a USING (ts) GROUP BY ALL), n AS (SELECT DISTINCT variable FROM obs), q AS (SELECT k, k * 0.37::DOUBLE AS t FROM (SELECT unnest(range(1000)) AS k)) "
    "SELECT n.variable, k, floor(t)::BIGINT AS lower, least(floor(t) + 1, last)::BIGINT AS upper, round(a.value + (b.value - a.value) * (t - floor(t)), 6) AS value FROM q CROSS JOIN m CROSS JOIN n LEFT JOIN v a ON a.variable = n.variable AND a.time_id = floor(t) LEFT JOIN v b ON b.variable = n.variable AND b.time_id = least(floor(t) + 1, last) WHERE floor(t) <= last"
)
def time_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between two steps; a missing side makes a missing value. Two equi-joins on the step."""
    from .catalog import axis_of

    o = obs(spark, sf_dir)
    axis = axis_of(o.select("ts"))
    v = o.join(axis, "ts").groupBy(*CELL).agg(F.avg("value").alias("value"))
    last, names = axis.agg(F.max("time_id")).scalar(), o.agg(F.collect_set("variable")).scalar()
    q = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 0.37).alias("t"), F.explode(names).alias("variable")).withColumn("last", last).withColumn("lower", F.floor("t")).filter("lower <= last").withColumn("upper", F.least(F.col("lower") + 1, F.col("last")))
    q = q.join(v.select("variable", F.col("time_id").alias("lower"), F.col("value").alias("a")), ["variable", "lower"], "left").join(v.select("variable", F.col("time_id").alias("upper"), F.col("value").alias("b")), ["variable", "upper"], "left")
    return q.select("variable", "k", "lower", "upper", F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("t") - F.col("lower")), 6).alias("value"))


def _weights(t: Column, i: Column) -> Column:
    """Catmull-Rom weight of the neighbour at offset i = 0..3 (from -1)."""
    w = [-0.5 * t * t * t + t * t - 0.5 * t, 1.5 * t * t * t - 2.5 * t * t + 1, -1.5 * t * t * t + 2.0 * t * t + 0.5 * t, 0.5 * t * t * t - 0.5 * t * t]
    return F.when(i == 0, w[0]).when(i == 1, w[1]).when(i == 2, w[2]).otherwise(w[3])


def windows(g: DataFrame) -> DataFrame:
    """variable, time_id, x0, y0, v, present: of each block every 4 x 4 cells around (x0, y0), row by row, with nulls for missing ones, and how many are there."""
    cells = F.array_sort(F.collect_list(F.struct((F.col("gy") * 20 + F.col("gx")).alias("k"), "value")))
    at = g.groupBy(*CELL).agg(cells.alias("c")).select(*CELL, F.col("c.value").alias("m"), F.explode(F.sequence(F.lit(1), F.lit(17))).alias("x0")).select("*", F.explode(F.sequence(F.lit(1), F.lit(17))).alias("y0"))
    at = at.withColumn("v", F.concat(*(F.slice("m", (F.col("y0") - 1 + j) * 20 + F.col("x0"), 4) for j in range(4))))
    return at.select(*CELL, "x0", "y0", "v", F.size(F.array_compact("v")).alias("present"))


_CR = lambda t, i: f"CASE {i} WHEN 0 THEN -0.5::DOUBLE*{t}*{t}*{t} + {t}*{t} - 0.5::DOUBLE*{t} WHEN 1 THEN 1.5::DOUBLE*{t}*{t}*{t} - 2.5::DOUBLE*{t}*{t} + 1 WHEN 2 THEN -1.5::DOUBLE*{t}*{t}*{t} + 2.0::DOUBLE*{t}*{t} + 0.5::DOUBLE*{t} ELSE 0.5::DOUBLE*{t}*{t}*{t} - 0.5::DOUBLE*{t}*{t} END"


@query(
    f"WITH {GRID_SQL}, {POINTS_SQL}, {_FRAC}, b AS (SELECT * FROM q WHERE x0 BETWEEN 1 AND 17 AND y0 BETWEEN 1 AND 17), k AS (SELECT point, (x0 + i - 1)::BIGINT AS gx, (y0 + j - 1)::BIGINT AS gy, ({_CR('(fx - x0)', 'i')}) * ({_CR('(fy - y0)', 'j')}) AS w FROM b, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)) SELECT point, variable, time_id, CASE WHEN count(value) = 16 THEN round(sum(w * value), 3) END AS value FROM k JOIN grid USING (gx, gy) GROUP BY ALL"
)
def bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catmull-Rom samples from 16 neighbours, a margin of one cell kept; one missing makes it missing.

    Each block's windows of 4 x 4 cells, 289 whatever the input, are broadcast; the points are not, nor are they unfolded: a sample is made within a row. Rows of one point are counted first, as the SQL adds them up."""
    x, y = grid_position(F.col("lat"), F.col("lon"), GRID)
    p = points(spark, sf_dir).withColumns({"fx": x, "fy": y}).withColumns({"x0": F.floor("fx"), "y0": F.floor("fy")}).filter("x0 BETWEEN 1 AND 17 AND y0 BETWEEN 1 AND 17 AND fx <= 19 AND fy <= 19")
    p = p.groupBy("point", "fx", "fy", "x0", "y0").agg(F.count("*").alias("n"))
    w = {f"w{a}{i}": _weights(F.col(f"f{a}") - F.col(f"{a}0"), F.lit(i)) for a in "xy" for i in range(4)}
    p = p.withColumns(w).select("point", "x0", "y0", "n", *w)
    hit = p.join(F.broadcast(windows(grid(spark, sf_dir))), ["x0", "y0"])
    terms = [F.coalesce(F.col(f"wx{i}") * F.col(f"wy{j}") * F.col("v")[4 * j + i], F.lit(0.0)) for j in range(4) for i in range(4)]
    return hit.select("point", *CELL, F.when(F.col("n") * F.col("present") == 16, F.round(F.col("n") * sum(terms[1:], terms[0]), 3)).alias("value"))


@query(f"WITH {GRID_SQL} SELECT variable, time_id, gx // 8 AS cx, gy // 8 AS cy, count(*)::BIGINT AS cells, count(value)::BIGINT AS present, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM grid GROUP BY ALL")
def grid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid in chunks of 8 x 8, edge chunks smaller."""
    g = grid(spark, sf_dir)
    return g.groupBy(*CELL, F.expr("gx DIV 8").alias("cx"), F.expr("gy DIV 8").alias("cy")).agg(F.count("*").alias("cells"), F.count("value").alias("present"), F.round(F.min("value"), 4).alias("lo"), F.round(F.max("value"), 4).alias("hi"))


_PIX = "px AS (SELECT x, y, i AS pc, j AS pr, (x + (i + 0.5::DOUBLE) / 8) / 64 * 360 - 180 AS lon, 3.141592653589793::DOUBLE * (1 - 2 * (y + (j + 0.5::DOUBLE) / 8) / 64) AS m FROM (SELECT unnest(range(32, 34)) AS x), (SELECT unnest(range(21, 24)) AS y), (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))"


@query(
    f"WITH {GRID_SQL}, {_PIX}, p AS (SELECT *, lon / 0.5::DOUBLE AS fx, (degrees(atan((exp(m) - exp(-m)) / 2)) - 40) / 0.5::DOUBLE AS fy FROM px), q AS (SELECT *, floor(fx) AS x0, floor(fy) AS y0 FROM p WHERE fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19), {_CORNER} SELECT k.x, k.y, pr, pc, variable, time_id, CASE WHEN count(value) = 4 THEN round(sum(w * value), 3) END AS value FROM k JOIN grid USING (gx, gy) GROUP BY ALL"
)
def grid_to_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid resampled to Web Mercator pixels: pixel centres are points, their neighbours joined by equality."""
    from ..functions import addressing as A

    z = F.lit(6)
    px = spark.range(2).select((F.col("id") + 32).alias("x")).select("x", F.explode(F.expr("sequence(21L, 23L)")).alias("y")).select("x", "y", F.explode(F.expr("sequence(0L, 63L)")).alias("k"))
    px = px.select("x", "y", F.expr("k DIV 8").alias("pr"), (F.col("k") % 8).alias("pc"))
    px = px.withColumns({"lon": A.pixel_lon(z, F.col("x"), F.col("pc"), 8), "lat": A.pixel_lat(z, F.col("y"), F.col("pr"), 8)})
    c = corners(px, GRID)
    w = F.when(F.col("o.i") == 1, F.col("u")).otherwise(1 - F.col("u")) * F.when(F.col("o.j") == 1, F.col("v")).otherwise(1 - F.col("v"))
    hit = c.select("x", "y", "pr", "pc", "gx", "gy", w.alias("w")).join(grid(spark, sf_dir), ["gx", "gy"])
    return hit.groupBy("x", "y", "pr", "pc", *CELL).agg(F.when(F.count("value") == 4, F.round(F.sum(F.col("w") * F.col("value")), 3)).alias("value"))


@query(f"WITH {CELLS_SQL}, s AS (SELECT c_custkey, (40 + (c_custkey * 7 % 100) / 10.0::DOUBLE) AS lat, ((c_custkey * 13 % 100) / 10.0::DOUBLE) AS lon FROM customer) SELECT c_custkey, round(lon / 0.5::DOUBLE)::BIGINT AS gx, round((lat - 40) / 0.5::DOUBLE)::BIGINT AS gy, c.variable, c.time_id, c.value FROM s LEFT JOIN cells c ON c.gx = round(lon / 0.5::DOUBLE)::BIGINT AND c.gy = round((lat - 40) / 0.5::DOUBLE)::BIGINT")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the nearest cell in each block; null off the grid."""
    p = points(spark, sf_dir)
    x, y = grid_position(F.col("lat"), F.col("lon"), GRID)
    p = p.select(F.col("point").alias("c_custkey"), F.round(x).cast("long").alias("gx"), F.round(y).cast("long").alias("gy"))
    c = present_cells(spark, sf_dir)
    return p.join(c, ["gx", "gy"], "left").select("c_custkey", "gx", "gy", *CELL, "value")
