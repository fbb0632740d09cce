"""Queries over fields: contours, bands, colours, wind and series summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..views import CELLS_SQL, GRID_SQL, OBS_SQL, TILES_SQL, grid, obs, present_cells, table, tile_arrays

# Colour stops, evenly spaced over [0, 1].
VIRIDIS = [(68, 1, 84), (72, 35, 116), (64, 67, 135), (52, 94, 141), (41, 121, 142), (32, 144, 140), (34, 167, 132), (68, 190, 112), (253, 231, 37)]


def contour_level(v: Column, spacing: float) -> Column:
    return F.floor(v / spacing + 0.5)


@query(
    f"WITH {GRID_SQL}, n AS (SELECT *, floor(value / 5000 + 0.5::DOUBLE) AS lv, floor(lead(value) OVER (PARTITION BY variable, time_id, gy ORDER BY gx) / 5000 + 0.5::DOUBLE) AS east, floor(lead(value) OVER (PARTITION BY variable, time_id, gx ORDER BY gy) / 5000 + 0.5::DOUBLE) AS south FROM grid) "
    "SELECT variable, time_id, gy, gx, coalesce(lv <> east, false) AS cross_east, coalesce(lv <> south, false) AS cross_south, greatest(lv, east, south)::BIGINT % 5 = 0 AS major FROM n WHERE lv IS NOT NULL AND (lv <> east OR lv <> south)"
)
def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells where the contour level changes to the east or south; every fifth level is major. Both neighbours in one window per block row and column."""
    g = grid(spark, sf_dir)
    lv = contour_level(F.col("value"), 5000)
    east = F.lead("value").over(Window.partitionBy("variable", "time_id", "gy").orderBy("gx"))
    south = F.lead("value").over(Window.partitionBy("variable", "time_id", "gx").orderBy("gy"))
    n = g.select("*", lv.alias("lv"), contour_level(east, 5000).alias("east"), contour_level(south, 5000).alias("south"))
    n = n.filter("lv IS NOT NULL AND (lv != east OR lv != south)")
    no = F.lit(False)
    return n.select("variable", "time_id", "gy", "gx", F.coalesce(F.col("lv") != F.col("east"), no).alias("cross_east"), F.coalesce(F.col("lv") != F.col("south"), no).alias("cross_south"), (F.greatest("lv", "east", "south") % 5 == 0).alias("major"))


def nice(raw: Column) -> Column:
    """1, 2 or 5 times a power of ten, not above raw; 1 if raw isn't positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    r = raw / base
    return F.when(raw > 0, F.when(r >= 5, 5).when(r >= 2, 2).otherwise(1) * base).otherwise(1.0)


@query(
    f"WITH {CELLS_SQL}, s AS (SELECT variable, time_id, greatest(max(value) - min(value), 1e-6::DOUBLE) / 25 AS raw FROM cells GROUP BY ALL) SELECT variable, time_id, round((CASE WHEN raw / pow(10.0::DOUBLE, floor(log10(raw))) >= 5 THEN 5 WHEN raw / pow(10.0::DOUBLE, floor(log10(raw))) >= 2 THEN 2 ELSE 1 END) * pow(10.0::DOUBLE, floor(log10(raw))), 6) AS spacing, round((CASE WHEN raw / pow(10.0::DOUBLE, floor(log10(raw))) >= 5 THEN 5 WHEN raw / pow(10.0::DOUBLE, floor(log10(raw))) >= 2 THEN 2 ELSE 1 END) * pow(10.0::DOUBLE, floor(log10(raw))) * pow(2.0::DOUBLE, greatest(0, 6 - time_id)), 6) AS effective FROM s"
)
def contour_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suggested spacing for each block, doubled for every zoom below the reference."""
    s = present_cells(spark, sf_dir).groupBy("variable", "time_id").agg((F.greatest(F.max("value") - F.min("value"), F.lit(1e-6)) / 25).alias("raw"))
    s = s.withColumn("n", nice(F.col("raw")))
    return s.select("variable", "time_id", F.round("n", 6).alias("spacing"), F.round(F.col("n") * F.pow(F.lit(2.0), F.greatest(F.lit(0), 6 - F.col("time_id"))), 6).alias("effective"))


BANDS = [("low", 0.0, 50000.0), ("mid", 40000.0, 80000.0), ("high", 80000.0, 200000.0)]


@query(f"WITH {CELLS_SQL}, b AS (SELECT * FROM (VALUES (0, 'low', 0.0::DOUBLE, 50000.0::DOUBLE), (1, 'mid', 40000.0::DOUBLE, 80000.0::DOUBLE), (2, 'high', 80000.0::DOUBLE, 200000.0::DOUBLE)) t(i, band, lo, hi)), m AS (SELECT variable, time_id, gy, gx, arg_max(band, i) AS band FROM cells JOIN b ON value >= lo AND value < hi GROUP BY ALL) SELECT variable, time_id, band, count(*)::BIGINT AS cells FROM m GROUP BY ALL")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """half-open bands, later ones over earlier ones; a CASE over the few bands, so no join."""
    band = F.lit(None).cast("string")
    for name, lo, hi in BANDS:
        band = F.when((F.col("value") >= lo) & (F.col("value") < hi), name).otherwise(band)
    return present_cells(spark, sf_dir).withColumn("band", band).filter("band IS NOT NULL").groupBy("variable", "time_id", "band").agg(F.count("*").alias("cells"))


def colour(t: Column, stops: list[tuple[int, int, int]]) -> list[Column]:
    """Red, green and blue of t in [0, 1], linear between evenly spaced stops."""
    n = len(stops) - 1
    at = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * n
    i = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    f = at - i
    chan = lambda k: F.array(*(F.lit(float(s[k])) for s in stops))
    return [F.get(chan(k), i) + (F.get(chan(k), i + 1) - F.get(chan(k), i)) * f for k in range(3)]


_LIST = lambda k: "[" + ", ".join(f"{s[k]}.0::DOUBLE" for s in VIRIDIS) + "]"
_MIXED = lambda k, name: f"round({_LIST(k)}[i + 1] + ({_LIST(k)}[i + 2] - {_LIST(k)}[i + 1]) * (at_ - i), 4) AS {name}"


@query(f"WITH {CELLS_SQL}, r AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM cells GROUP BY variable), t AS (SELECT c.*, least(greatest((value - lo) / nullif(hi - lo, 0), 0), 1) * 8 AS at_ FROM cells c JOIN r USING (variable)), p AS (SELECT *, least(floor(at_), 7)::INT AS i FROM t) SELECT variable, time_id, gy, gx, {_MIXED(0, 'red')}, {_MIXED(1, 'green')}, {_MIXED(2, 'blue')} FROM p")
def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised values as colours."""
    c = present_cells(spark, sf_dir)
    r = c.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    t = (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    red, green, blue = colour(t, VIRIDIS)
    return c.join(r, "variable").select("variable", "time_id", "gy", "gx", F.round(red, 4).alias("red"), F.round(green, 4).alias("green"), F.round(blue, 4).alias("blue"))


_UV = f"WITH {TILES_SQL}, uv AS (SELECT x, y, py, px, max(CASE WHEN variable % 2 = 0 THEN value::DOUBLE * 100 END) AS u, max(CASE WHEN variable % 2 = 1 THEN value::DOUBLE * 100 END) AS v FROM (SELECT variable, x // 2 AS x, y, py, px, value FROM tiles) GROUP BY ALL)"


def wind_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u and v at each pixel of neighbouring tiles: the two variables are paired by one grouping on the tile, then unfolded."""
    t = tile_arrays(spark, sf_dir)
    rows = t.select(F.expr("x DIV 2").alias("x"), "y", (F.col("variable") % 2).alias("odd"), F.posexplode("pixels").alias("p", "value"))
    part = lambda k: F.max(F.when(F.col("odd") == k, F.col("value").cast("double") * 100))
    uv = rows.groupBy("x", "y", "p").agg(part(0).alias("u"), part(1).alias("v"))
    return uv.select("x", "y", F.expr("p DIV 8").alias("py"), (F.col("p") % 8).alias("px"), "u", "v")


@query(_UV + " SELECT x, y, py, px, CASE WHEN u IS NULL OR v IS NULL OR (u = 0 AND v = 0) THEN NULL ELSE round(sqrt(u * u + v * v), 5) END AS speed, CASE WHEN u IS NULL OR v IS NULL OR (u = 0 AND v = 0) THEN NULL ELSE round(atan2(-v, u), 5) END AS bearing FROM uv")
def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed and bearing; null if a component is missing or both are zero."""
    u, v = F.col("u"), F.col("v")
    alive = u.isNotNull() & v.isNotNull() & ~((u == 0) & (v == 0))
    return wind_components(spark, sf_dir).select("x", "y", "py", "px", F.when(alive, F.round(F.sqrt(u * u + v * v), 5)).alias("speed"), F.when(alive, F.round(F.atan2(-v, u), 5)).alias("bearing"))


@query(_UV + ", k AS (SELECT *, least(greatest(floor(sqrt(u * u + v * v) * 1.943844::DOUBLE / 5 + 0.5), 0), 30)::BIGINT * 5 AS knots FROM uv WHERE u IS NOT NULL AND v IS NOT NULL) SELECT y < 4 AS north, knots, knots // 50 AS pennants, (knots % 50) // 10 AS full_barbs, (knots % 10) // 5 AS half_barbs, knots < 5 AS calm, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def wind_barb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds in steps of 5 knots as pennants, full and half barbs, by hemisphere."""
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")) * 1.943844
    k = wind_components(spark, sf_dir).filter("u IS NOT NULL AND v IS NOT NULL").withColumn("knots", F.least(F.greatest(F.floor(speed / 5 + 0.5), F.lit(0)), F.lit(30)) * 5)
    out = k.select((F.col("y") < 4).alias("north"), "knots", F.expr("knots DIV 50").alias("pennants"), F.expr("(knots % 50) DIV 10").alias("full_barbs"), F.expr("(knots % 10) DIV 5").alias("half_barbs"), (F.col("knots") < 5).alias("calm"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


STEPS = 6


@query(
    f"WITH RECURSIVE {CELLS_SQL}, w AS (SELECT time_id, gy, gx, max(CASE WHEN variable = 'A' THEN value END) / 100000 - 0.5 AS u, max(CASE WHEN variable = 'N' THEN value END) / 100000 - 0.5 AS v FROM cells GROUP BY ALL), "
    "f AS (SELECT p_partkey AS particle, t.time_id, 0 AS step, (p_partkey % 20)::DOUBLE AS x, (p_partkey * 7 % 20)::DOUBLE AS y FROM part CROSS JOIN (SELECT DISTINCT time_id FROM w) t UNION ALL SELECT particle, f.time_id, step + 1, x + w.u, y - w.v FROM f JOIN w ON w.time_id = f.time_id AND w.gx = floor(x) AND w.gy = floor(y) WHERE step < 6 AND w.u IS NOT NULL AND w.v IS NOT NULL) "
    "SELECT particle, time_id, max(step)::INT AS steps, round(arg_max(x, step), 4) AS x, round(arg_max(y, step), 4) AS y FROM f GROUP BY particle, time_id"
)
def advection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles carried by each month's wind for a fixed number of steps; they stop off the grid or where it is missing.

    The fields are small (400 cells a month) and go along as one value, arrays by cell, so no step shuffles the particles.
    """
    part = lambda k: F.max(F.when(F.col("variable") == k, F.col("value"))) / 100000 - 0.5
    w = present_cells(spark, sf_dir).groupBy("time_id", "gy", "gx").agg(part("A").alias("u"), part("N").alias("v"))
    cells = w.groupBy("time_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("gy") * 20 + F.col("gx")).alias("k"), F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.struct("u", "v"))))).alias("m"))
    cells = cells.select("time_id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long")), lambda k: F.try_element_at("m", k)).alias("field"))
    fields = cells.agg(F.collect_list(F.struct("time_id", "field"))).scalar()
    start = F.struct((F.col("p_partkey") % 20).cast("double").alias("x"), (F.col("p_partkey") * 7 % 20).cast("double").alias("y"), F.lit(0).alias("n"), F.lit(True).alias("alive"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(fields).alias("f")).select("p_partkey", "f.*").select(F.col("p_partkey").alias("particle"), "time_id", "field", start.alias("s"))

    def step(a: Column, _: Column) -> Column:
        inside = a["x"].between(0, 19.999999999) & a["y"].between(0, 19.999999999)
        wind_ = F.when(inside, F.get("field", (F.floor(a["y"]) * 20 + F.floor(a["x"])).cast("int")))
        go = a["alive"] & wind_.isNotNull()
        return F.struct(F.when(go, a["x"] + wind_["u"]).otherwise(a["x"]).alias("x"), F.when(go, a["y"] - wind_["v"]).otherwise(a["y"]).alias("y"), F.when(go, a["n"] + 1).otherwise(a["n"]).alias("n"), go.alias("alive"))

    end = p.select("particle", "time_id", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("s"), step).alias("e"))
    return end.select("particle", "time_id", F.col("e.n").alias("steps"), F.round("e.x", 4).alias("x"), F.round("e.y", 4).alias("y"))


@query(f"WITH {OBS_SQL}, s AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM obs GROUP BY variable) SELECT variable, round(CASE WHEN lo = hi THEN lo - 1 ELSE lo END, 6) AS lo, round(CASE WHEN lo = hi THEN hi + 1 ELSE hi END, 6) AS hi FROM s")
def sparkline_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of each series; a flat one is widened."""
    s = obs(spark, sf_dir).groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return s.select("variable", F.round(F.when(flat, F.col("lo") - 1).otherwise(F.col("lo")), 6).alias("lo"), F.round(F.when(flat, F.col("hi") + 1).otherwise(F.col("hi")), 6).alias("hi"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, max(CASE WHEN k = least(n - 1, floor(0.5::DOUBLE * n)) THEN value END) AS p50, max(CASE WHEN k = least(n - 1, floor(0.95::DOUBLE * n)) THEN value END) AS p95 FROM r GROUP BY event_type")
def rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and rank quantiles sorted[min(n - 1, floor(q n))]. Values are counted first, so that what is ranked is distinct values."""
    c = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    r = c.select("*", (F.sum("c").over(w.orderBy("value"))).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    pick = lambda q: F.max(F.when((at(q) < F.col("upto")) & (at(q) >= F.col("upto") - F.col("c")), F.col("value")))
    return r.groupBy("event_type").agg(F.max("n").alias("n"), F.round(F.sum(F.col("value") * F.col("c")) / F.max("n"), 6).alias("mean"), pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query(f"WITH {OBS_SQL}, r AS (SELECT variable, min(value) AS base FROM obs GROUP BY variable) SELECT variable, ts, round(sum(value - base), 4) AS shifted FROM obs JOIN r USING (variable) GROUP BY variable, ts")
def baseline_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values above their variable's minimum, summed by hour."""
    o = obs(spark, sf_dir)
    h = o.groupBy("variable", "ts").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    base = o.groupBy("variable").agg(F.min("value").alias("base"))
    return h.join(base, "variable").select("variable", "ts", F.round(F.col("s") - F.col("n") * F.col("base"), 4).alias("shifted"))


@query("WITH w AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day_, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT * FROM w")
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z09 (extra): tumbling windows of a day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day_"), "n", "total")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z09 (extra): sessions of a user that end after two hours."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first_"), "n")
