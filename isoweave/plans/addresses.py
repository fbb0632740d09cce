"""Queries over tile and pixel addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addressing as A
from ..registry import query
from ..views import OBS_SQL, obs, table

_ZXY = "zxy AS (SELECT vec_id, (vec_id % 13)::INT AS z, (vec_id * 7919) % (1 << (vec_id % 13)::INT) AS x, (vec_id * 104729) % (1 << (vec_id % 13)::INT) AS y FROM embeddings)"
_HILBERT = f"""WITH RECURSIVE {_ZXY}, f AS (SELECT vec_id, z, x AS x0, y AS y0, z - 1 AS i, x, y, 0::BIGINT AS d FROM zxy UNION ALL
SELECT vec_id, z, x0, y0, i - 1,
  CASE WHEN (y >> i) & 1 = 0 THEN (CASE WHEN (x >> i) & 1 = 1 THEN (1 << z) - 1 - y ELSE y END) ELSE x END,
  CASE WHEN (y >> i) & 1 = 0 THEN (CASE WHEN (x >> i) & 1 = 1 THEN (1 << z) - 1 - x ELSE x END) ELSE y END,
  d + xor(3 * ((x >> i) & 1), (y >> i) & 1) * (1::BIGINT << (2 * i)) FROM f WHERE i >= 0)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    side = A.shl(1, F.col("z"))
    return e.select("vec_id", (F.col("vec_id") % 13).cast("int").alias("z")).select("vec_id", "z", (F.col("vec_id") * 7919 % side).alias("x"), (F.col("vec_id") * 104729 % side).alias("y"))


@query(_HILBERT + "SELECT vec_id, z, x0 AS x, y0 AS y, d, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id FROM f WHERE i = -1")
def hilbert_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hilbert place and id of each requested tile."""
    z, x, y = (F.col(c) for c in "zxy")
    return requests(spark, sf_dir).withColumns({"d": A.hilbert_distance(z, x, y), "tile_id": A.tile_id(z, x, y)})


@query(
    """WITH RECURSIVE ids AS (SELECT vec_id, vec_id * 104729 AS id FROM embeddings), zs AS (SELECT vec_id, id, (len(bin(3 * id + 1)) - 1) // 2 AS z FROM ids),
f AS (SELECT vec_id, id, z, 0 AS i, 0::BIGINT AS x, 0::BIGINT AS y, id - ((1::BIGINT << (2 * z)) - 1) // 3 AS t FROM zs UNION ALL
SELECT vec_id, id, z, i + 1,
  (CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN (1 << i) - 1 - y ELSE y END) ELSE x END) + (rx << i),
  (CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN (1 << i) - 1 - x ELSE x END) ELSE y END) + (ry << i), t >> 2
  FROM (SELECT *, (t >> 1) & 1 AS rx, xor(t, (t >> 1) & 1) & 1 AS ry FROM f) WHERE i < z)
SELECT vec_id, id AS tile_id, z::INT AS z, x, y FROM f WHERE i = z"""
)
def hilbert_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom, column and row of a tile id."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 104729).alias("tile_id"))
    ids = ids.withColumn("z", A.tile_zoom(F.col("tile_id")))
    xy = A.hilbert_tile(F.col("z"), F.col("tile_id") - A.zoom_offset(F.col("z")))
    return ids.withColumn("xy", xy).select("vec_id", "tile_id", "z", "xy.x", "xy.y")


@query(_HILBERT + "SELECT vec_id, z, row_number() OVER (PARTITION BY z ORDER BY d, vec_id)::BIGINT AS place FROM f WHERE i = -1")
def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a zoom in Hilbert order."""
    from pyspark.sql import Window

    d = A.hilbert_distance(*(F.col(c) for c in "zxy"))
    return requests(spark, sf_dir).select("vec_id", "z", d.alias("d")).select("vec_id", "z", F.row_number().over(Window.partitionBy("z").orderBy("d", "vec_id")).cast("long").alias("place"))


@query("SELECT z, ((1::BIGINT << (2 * z)) - 1) // 3 AS zoom_offset, ((1::BIGINT << (2 * z + 2)) - 1) // 3 AS tiles FROM (SELECT unnest(range(16))::INT AS z)")
def zoom_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids before each zoom, and all ids up to it."""
    z = F.col("z")
    return spark.range(16).select(F.col("id").cast("int").alias("z")).withColumns({"zoom_offset": A.zoom_offset(z), "tiles": A.num_tiles(z)})


@query("SELECT o_orderkey, k, (k >> 32)::INT AS variable, (k & 4294967295)::BIGINT AS time_id FROM (SELECT o_orderkey, ((o_custkey % 1000) << 32) | (o_orderkey % 100000) AS k FROM orders)")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block keys and what they are made of."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", A.block_key(F.col("o_custkey") % 1000, F.col("o_orderkey") % 100000).alias("k"))
    return o.withColumns({"variable": A.key_variable(F.col("k")), "time_id": A.key_time(F.col("k"))})


_PLACE = "SELECT event_id, ((user_id * 17) % 180 - 90)::DOUBLE + 0.37::DOUBLE AS lat, ((user_id * 37) % 720 - 360)::DOUBLE + 0.11::DOUBLE AS lon, (event_id % 9)::INT AS z FROM events"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", ((F.col("user_id") * 17 % 180 - 90).cast("double") + 0.37).alias("lat"), ((F.col("user_id") * 37 % 720 - 360).cast("double") + 0.11).alias("lon"), (F.col("event_id") % 9).cast("int").alias("z"))


_MY = "(1 - ln(tan((90 + greatest(least(lat, 85.05112877980659::DOUBLE), -85.05112877980659::DOUBLE)) * 3.141592653589793::DOUBLE / 360)) / 3.141592653589793::DOUBLE) / 2"
_MX = "((((lon + 180) % 360) + 360) % 360) / 360"


@query(
    f"WITH p AS ({_PLACE}), t AS (SELECT *, {_MX} * (1 << z) AS xt, {_MY} * (1 << z) AS yt FROM p WHERE lat BETWEEN -90 AND 90), i AS (SELECT *, greatest(least(floor(xt), (1 << z) - 1), 0) AS x, greatest(least(floor(yt), (1 << z) - 1), 0) AS y FROM t) "
    "SELECT event_id, z, x::BIGINT AS x, y::BIGINT AS y, greatest(least(floor((xt - x) * 256), 255), 0)::BIGINT AS col_, greatest(least(floor((yt - y) * 256), 255), 0)::BIGINT AS row_ FROM i"
)
def latlon_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile and pixel that hold each place; longitudes wrap, places off the poles have none."""
    p = places(spark, sf_dir).withColumn("t", A.tile_pixel(F.col("z"), F.col("lat"), F.col("lon"), 256)).filter("lat BETWEEN -90 AND 90")
    return p.select("event_id", "z", "t.x", "t.y", F.col("t.col").alias("col_"), F.col("t.row").alias("row_"))


@query(
    f"WITH {_ZXY}, a AS (SELECT *, 3.141592653589793::DOUBLE * (1 - 2 * (y + ((vec_id * 3 % 256) + 0.5::DOUBLE) / 256) / (1 << z)) AS m FROM zxy) SELECT vec_id, round((x + ((vec_id % 256) + 0.5::DOUBLE) / 256) / (1 << z) * 360 - 180, 8) AS lon, round(degrees(atan((exp(m) - exp(-m)) / 2)), 8) AS lat FROM a"
)
def pixel_latlon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a pixel's centre."""
    z, x, y = (F.col(c) for c in "zxy")
    r = requests(spark, sf_dir)
    return r.select("vec_id", F.round(A.pixel_lon(z, x, F.col("vec_id") % 256, 256), 8).alias("lon"), F.round(A.pixel_lat(z, y, F.col("vec_id") * 3 % 256, 256), 8).alias("lat"))


@query(
    f"WITH {_ZXY}, a AS (SELECT *, 3.141592653589793::DOUBLE * (1 - 2 * y::DOUBLE / (1 << z)) AS m0, 3.141592653589793::DOUBLE * (1 - 2 * (y + 1)::DOUBLE / (1 << z)) AS m1 FROM zxy) "
    "SELECT vec_id, round(x::DOUBLE / (1 << z) * 360 - 180, 8) AS west, round((x + 1)::DOUBLE / (1 << z) * 360 - 180, 8) AS east, round(degrees(atan((exp(m0) - exp(-m0)) / 2)), 8) AS north, round(degrees(atan((exp(m1) - exp(-m1)) / 2)), 8) AS south FROM a"
)
def tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of a tile."""
    z, x, y = (F.col(c) for c in "zxy")
    lat = lambda r: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * r.cast("double") / A.shl(1, z)))))
    lon = lambda k: k.cast("double") / A.shl(1, z) * 360 - 180
    return requests(spark, sf_dir).select("vec_id", F.round(lon(x), 8).alias("west"), F.round(lon(x + 1), 8).alias("east"), F.round(lat(y), 8).alias("north"), F.round(lat(y + 1), 8).alias("south"))


_BOXES = "boxes AS (SELECT variable, 4 AS z, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM obs GROUP BY variable)"
_NY = lambda c: f"floor((1 - ln(tan((90 + greatest(least({c}, 85.05112877980659::DOUBLE), -85.05112877980659::DOUBLE)) * 3.141592653589793::DOUBLE / 360)) / 3.141592653589793::DOUBLE) / 2 * (1 << z))"


@query(
    f"WITH {OBS_SQL}, {_BOXES}, r AS (SELECT variable, z, greatest(floor((w + 180) / 360 * (1 << z)), 0)::BIGINT AS x0, least(greatest(floor((e + 180) / 360 * (1 << z) - 1e-9::DOUBLE), floor((w + 180) / 360 * (1 << z))), (1 << z) - 1)::BIGINT AS x1, greatest({_NY('n')}, 0)::BIGINT AS y0, least({_NY('s')}, (1 << z) - 1)::BIGINT AS y1 FROM boxes), "
    "c AS (SELECT variable, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r) SELECT variable, z, x, unnest(range(y0, y1 + 1)) AS y FROM c"
)
def tile_cover_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that meet each variable's box."""
    b = obs(spark, sf_dir).groupBy("variable").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n")).withColumn("z", F.lit(4))
    x0, x1, y0, y1 = A.tile_span(*(F.col(c) for c in "zwsen"))
    r = b.select("variable", "z", *(v.cast("long").alias(k) for k, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))))
    return r.select("variable", "z", F.explode(F.expr("sequence(x0, x1)")).alias("x"), "y0", "y1").select("variable", "z", "x", F.explode(F.expr("sequence(y0, y1)")).alias("y"))


@query(f"WITH {OBS_SQL} SELECT greatest(least(round(min(lon) * 1e7::DOUBLE), 2147483647), -2147483648)::INT AS west, greatest(least(round(min(lat) * 1e7::DOUBLE), 2147483647), -2147483648)::INT AS south, greatest(least(round(max(lon) * 1e7::DOUBLE), 2147483647), -2147483648)::INT AS east, greatest(least(round(max(lat) * 1e7::DOUBLE), 2147483647), -2147483648)::INT AS north FROM obs")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all boxes in fixed-point degrees."""
    o = obs(spark, sf_dir)
    return o.agg(A.fixed_degrees(F.min("lon")).alias("west"), A.fixed_degrees(F.min("lat")).alias("south"), A.fixed_degrees(F.max("lon")).alias("east"), A.fixed_degrees(F.max("lat")).alias("north"))


@query("SELECT e.event_id, CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END AS lon, CASE WHEN lo1 > 180 THEN lo1 - 360 ELSE lo1 END AS lo1, nx * 0.25::DOUBLE >= 359.75 AS global FROM (SELECT event_id, ((user_id * 37) % 720 - 360)::DOUBLE AS lon, ((event_id * 11) % 360)::DOUBLE AS lo1, 1300 + event_id % 200 AS nx FROM events) e")
def lon_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes of -180..180 for grids of 0..360, and whether a grid goes round the globe."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 37 % 720 - 360).cast("double").alias("a"), (F.col("event_id") * 11 % 360).cast("double").alias("b"), (1300 + F.col("event_id") % 200).alias("nx"))
    return e.select("event_id", F.expr("CASE WHEN a > 180 THEN a - 360 WHEN a < -180 THEN a + 360 ELSE a END").alias("lon"), F.expr("CASE WHEN b > 180 THEN b - 360 ELSE b END").alias("lo1"), (F.col("nx") * 0.25 >= 359.75).alias("global"))


_STERE = "SELECT event_id, radians(50 + (event_id % 60) / 4.0::DOUBLE) AS phi, radians((event_id % 80) / 4.0::DOUBLE - 10) AS dlam FROM events"


@query(
    f"WITH p AS ({_STERE}), k AS (SELECT 6378137.0::DOUBLE AS a, 0.0818191908426215::DOUBLE AS e, radians(60.0::DOUBLE) AS ts), q AS (SELECT p.*, k.*, tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2) AS t, tan(pi() / 4 - ts / 2) / pow((1 - e * sin(ts)) / (1 + e * sin(ts)), e / 2) AS tc, cos(ts) / sqrt(1 - e * e * sin(ts) * sin(ts)) AS mc FROM p, k) SELECT event_id, round(a * mc * t / tc * sin(dlam), 3) AS px, round(-a * mc * t / tc * cos(dlam), 3) AS py FROM q"
)
def stere_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polar stereographic metres (ellipsoid, true at 60 N, about the meridian 0)."""
    import math

    e, ts, a = 0.0818191908426215, math.radians(60.0), 6378137.0
    p = table(spark, sf_dir, "events").select("event_id", F.radians(50 + F.col("event_id") % 60 / 4.0).alias("phi"), F.radians(F.col("event_id") % 80 / 4.0 - 10).alias("dlam"))
    s = F.sin("phi")
    t = F.tan(math.pi / 4 - F.col("phi") / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    tc = math.tan(math.pi / 4 - ts / 2) / ((1 - e * math.sin(ts)) / (1 + e * math.sin(ts))) ** (e / 2)
    rho = F.lit(a * math.cos(ts) / math.sqrt(1 - e * e * math.sin(ts) ** 2) / tc) * t
    return p.select("event_id", F.round(rho * F.sin("dlam"), 3).alias("px"), F.round(-rho * F.cos("dlam"), 3).alias("py"))


@query("SELECT s_suppkey, '+proj=stere +lat_0=90 +lon_0=' || (s_suppkey % 30)::VARCHAR || ' +lat_ts=60 +a=6378137' AS proj, (s_suppkey % 30)::DOUBLE AS lon_0, 60.0::DOUBLE AS lat_ts, 'stere' AS kind FROM supplier")
def proj_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a projection string, as a map."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("+proj=stere +lat_0=90 +lon_0="), (F.col("s_suppkey") % 30).cast("string"), F.lit(" +lat_ts=60 +a=6378137")).alias("proj"))
    m = F.str_to_map(F.regexp_replace("proj", r"\+", ""), F.lit(" "), F.lit("="))
    return s.withColumn("m", m).select("s_suppkey", "proj", F.col("m")["lon_0"].cast("double").alias("lon_0"), F.col("m")["lat_ts"].cast("double").alias("lat_ts"), F.col("m")["proj"].alias("kind"))
