"""Queries over tiles: quantisation, reading, content and fidelity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions.addressing import tile_id
from ..registry import query
from ..views import CELLS_SQL, GRID_SQL, TILES_SQL, grid, tile_arrays, tiles

BLOCK = ["variable", "time_id"]


def precision(variable: Column) -> Column:
    """A step for each of the four ways a block can be kept."""
    return F.element_at(F.array(*map(F.lit, (0.01, 0.0001, 0.0, 0.000001))), (variable % 4 + 1).cast("int"))


def block_params(pixels: DataFrame) -> DataFrame:
    """A row a block: range of the present values and fitted parameters. Partial ranges before the shuffle."""
    v = Q.present(F.col("value").cast("double"))
    b = pixels.groupBy(*BLOCK).agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.count(v).alias("n"))
    dtype, scale, offset = Q.fit(F.col("vmin"), F.col("vmax"), precision(F.col("variable")))
    return b.filter("n > 0").withColumns({"dtype": dtype.cast("int"), "scale": scale, "offset_": offset})


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with their block's parameters, code and decoded value. The dimension of blocks is joined, small or not, as Spark sees fit."""
    px = tiles(spark, sf_dir)
    out = px.join(block_params(px), BLOCK)
    c = F.col
    out = out.withColumn("q", Q.quantized(c("value"), c("dtype"), c("scale"), c("offset_")))
    return out.withColumn("decoded", Q.dequantized(c("q"), c("value"), c("dtype"), c("scale"), c("offset_")))


PARAMS_SQL = (
    "WITH "
    + TILES_SQL
    + """, r AS (SELECT variable, time_id, min(value::DOUBLE) AS vmin, max(value::DOUBLE) AS vmax, count(value) AS n, CASE variable % 4 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 0.0001::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 0.000001::DOUBLE END AS p FROM tiles GROUP BY variable, time_id),
c AS (SELECT *, CASE WHEN p > 0 THEN ceil((vmax - vmin) / p) + 1 END AS codes FROM r WHERE n > 0),
params AS (SELECT variable, time_id, vmin, vmax, n,
  CASE WHEN vmin = vmax THEN 1 WHEN p > 0 AND codes <= 255 THEN 0 WHEN p > 0 AND codes <= 65535 THEN 1 WHEN p > 0 THEN 3 ELSE 1 END AS dtype,
  CASE WHEN vmin = vmax THEN 0.0::DOUBLE WHEN p > 0 AND codes <= 65535 THEN p WHEN p > 0 THEN 1.0::DOUBLE ELSE (vmax - vmin) / 65534.0::DOUBLE END AS scale,
  CASE WHEN vmin = vmax OR (p > 0 AND codes <= 65535) OR p = 0 THEN vmin ELSE 0.0::DOUBLE END AS offset_ FROM c),
r32 AS (SELECT t.*, k.vmin, k.vmax, k.dtype, k.scale, k.offset_, (t.value - k.offset_::FLOAT) * (CASE WHEN k.scale = 0 THEN NULL ELSE (1.0::DOUBLE / k.scale) END)::FLOAT AS r, CASE WHEN k.dtype = 0 THEN 254 ELSE 65534 END AS top FROM tiles t JOIN params k USING (variable, time_id)),
coded AS (SELECT *, CASE WHEN dtype = 3 THEN value ELSE (q::DOUBLE * scale + offset_)::FLOAT END AS decoded FROM (SELECT *, CASE WHEN value IS NULL OR dtype = 3 THEN NULL WHEN scale = 0 THEN 0 WHEN r <= 0::FLOAT THEN 0 WHEN r >= top::FLOAT THEN top ELSE floor(r + 0.5::FLOAT)::INT END AS q FROM r32))
"""
)


@query(PARAMS_SQL + "SELECT variable, time_id, dtype, round(scale, 12) AS scale, round(offset_, 9) AS block_offset, n::BIGINT AS n FROM params")
def fit_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of each block that has a value."""
    return block_params(tiles(spark, sf_dir)).select(*BLOCK, "dtype", F.round("scale", 12).alias("scale"), F.round("offset_", 9).alias("block_offset"), "n")


@query(PARAMS_SQL + "SELECT variable, time_id, x, y, py, px, q, round(decoded::DOUBLE, 6) AS decoded FROM coded")
def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q02, Q03: the code and decoded value of every pixel."""
    return coded(spark, sf_dir).select(*BLOCK, "x", "y", "py", "px", "q", F.round(F.col("decoded").cast("double"), 6).alias("decoded"))


_ERROR = "abs(decoded::DOUBLE - value::DOUBLE)"
_TOL = "(abs(scale) / 2 + 2 * (CASE WHEN greatest(abs(vmin), abs(vmax)) = 0 THEN 1.0::DOUBLE ELSE greatest(abs(vmin), abs(vmax)) END) * 1.1920929e-7::DOUBLE)"


@query(PARAMS_SQL + f"SELECT variable, time_id, count(*)::BIGINT AS n, round(max({_ERROR}), 7) AS worst, round(max({_TOL}), 9) AS tolerance, bool_and({_ERROR} <= {_TOL}) AS within FROM coded GROUP BY variable, time_id")
def fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each block the worst error against its bound."""
    c = coded(spark, sf_dir)
    err = F.abs(F.col("decoded").cast("double") - F.col("value").cast("double"))
    tol = Q.tolerance(F.col("scale"), F.col("vmin"), F.col("vmax"))
    return c.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.round(F.max(err), 7).alias("worst"), F.round(F.max(tol), 9).alias("tolerance"), F.every(err <= tol).alias("within"))


_STATS = f"""count(*)::BIGINT AS n, count(*) FILTER (WHERE {_ERROR} <= {_TOL})::BIGINT AS within, round(avg({_ERROR}), 8) AS mean_error, round(sqrt(avg({_ERROR} * {_ERROR})), 8) AS rmse, round(max({_ERROR}), 8) AS worst"""


@query(PARAMS_SQL + f"SELECT variable, {_STATS} FROM coded GROUP BY ROLLUP (variable)")
def compare_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08 over variables with an overall row, as the comparison report has it."""
    c = coded(spark, sf_dir)
    err = F.abs(F.col("decoded").cast("double") - F.col("value").cast("double"))
    tol = Q.tolerance(F.col("scale"), F.col("vmin"), F.col("vmax"))
    return c.rollup("variable").agg(F.count("*").alias("n"), F.count_if(err <= tol).alias("within"), F.round(F.avg(err), 8).alias("mean_error"), F.round(F.sqrt(F.avg(err * err)), 8).alias("rmse"), F.round(F.max(err), 8).alias("worst"))


@query(
    PARAMS_SQL
    + f"SELECT variable, time_id, x, y, py, px, round(e, 8) AS error FROM (SELECT *, {_ERROR} AS e, row_number() OVER (PARTITION BY variable ORDER BY {_ERROR} DESC, time_id, y, x, py, px) AS k FROM coded) WHERE k = 1"
)
def worst_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each variable the pixel with the largest error; the first in (time, y, x, row, column) of equals. One maximum of a struct, no sort."""
    c = coded(spark, sf_dir).withColumn("e", F.abs(F.col("decoded").cast("double") - F.col("value").cast("double")))
    place = F.struct("e", *((-F.col(k).cast("long")).alias(k) for k in ("time_id", "y", "x", "py", "px")))
    w = c.groupBy("variable").agg(F.max(place).alias("w"))
    return w.select("variable", *((-F.col(f"w.{k}")).alias(k) for k in ("time_id", "x", "y", "py", "px")), F.round("w.e", 8).alias("error"))


@query("WITH " + TILES_SQL + "SELECT x, y, py, px, round(value::DOUBLE, 6) AS value FROM tiles WHERE variable = 3 AND time_id BETWEEN 0 AND 4 AND z = 6 AND x = (SELECT min(x) FROM tiles WHERE variable = 3 AND time_id = 0) AND y = 0".replace("SELECT x, y, py", " SELECT x, y, py", 1))
def tile_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of one tile of a variable; the filters reach the scan before any pixel is unfolded."""
    a = tile_arrays(spark, sf_dir).filter("variable = 3 AND time_id BETWEEN 0 AND 4 AND z = 6 AND y = 0")
    first = tile_arrays(spark, sf_dir).filter("variable = 3 AND time_id = 0").agg(F.min("x").alias("x"))
    one = a.join(F.broadcast(first), "x", "left_semi")  # a single row
    return one.select("x", "y", F.posexplode("pixels").alias("p", "v")).select("x", "y", F.expr("p DIV 8").alias("py"), (F.col("p") % 8).alias("px"), F.round(F.col("v").cast("double"), 6).alias("value"))


_WANT = "want AS (SELECT k AS ord, 6 AS z, (k * 5) % 70 AS x, k % 3 AS y FROM (SELECT unnest(range(40)) AS k))"


@query(
    "WITH "
    + TILES_SQL
    + f", {_WANT}, sums AS (SELECT variable, z, x, y, count(value) AS n, sum(value::DOUBLE) AS s FROM tiles GROUP BY ALL) SELECT ord, w.z, w.x, w.y, w.x < 64 AND w.y < 64 AS valid, s.variable, coalesce(s.n, 0)::BIGINT AS n, round(s.s, 5) AS total FROM want w LEFT JOIN sums s USING (z, x, y)"
)
def tiles_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewport's tiles in request order, absent and invalid ones as nulls. The requests are 40 rows."""
    k = F.col("id")
    want = spark.range(40).select(k.alias("ord"), F.lit(6).alias("z"), (k * 5 % 70).alias("x"), (k % 3).alias("y"))
    t = tile_arrays(spark, sf_dir)
    sums = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
    t = t.select("variable", "z", "x", "y", F.size(F.filter("pixels", lambda v: v.isNotNull())).cast("long").alias("n"), sums.alias("total"))
    t = t.join(F.broadcast(want.select("z", "x", "y").distinct()), ["z", "x", "y"], "left_semi").groupBy("variable", "z", "x", "y").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = want.join(t, ["z", "x", "y"], "left")
    return out.select("ord", "z", "x", "y", ((F.col("x") < 64) & (F.col("y") < 64)).alias("valid"), "variable", F.coalesce("n", F.lit(0)).alias("n"), F.round("total", 5).alias("total"))


_ROUNDED = "WITH " + TILES_SQL + ", content AS (SELECT variable, time_id, x, y, string_agg(floor(value::DOUBLE * 1.25 + 0.5)::INT::VARCHAR, ',' ORDER BY py, px) AS blob FROM tiles GROUP BY variable, time_id, x, y)"


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with their content: coarse codes of all pixels, so that equal ones occur."""
    t = tile_arrays(spark, sf_dir)
    return t.select(*BLOCK, "z", "x", "y", F.array_join(F.transform("pixels", lambda v: F.floor(v.cast("double") * 1.25 + 0.5).cast("int").cast("string")), ",").alias("blob"))


@query(_ROUNDED + " SELECT variable, time_id, count(*)::BIGINT AS addressed, count(DISTINCT blob)::BIGINT AS contents, round(100.0::DOUBLE * count(DISTINCT blob) / count(*), 6) AS percent FROM content GROUP BY variable, time_id")
def dedup_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addressed tiles and distinct contents of each block; grouped by content first, so a hot block is counted in parts."""
    one = contents(spark, sf_dir).groupBy(*BLOCK, "blob").agg(F.count("*").alias("n"))
    out = one.groupBy(*BLOCK).agg(F.sum("n").alias("addressed"), F.count("*").alias("contents"))
    return out.withColumn("percent", F.round(100.0 * F.col("contents") / F.col("addressed"), 6))


@query(_ROUNDED + " SELECT count(DISTINCT (variable, time_id))::BIGINT AS blocks, count(*)::BIGINT AS addressed, count(DISTINCT (variable, time_id, blob))::BIGINT AS contents, sum(length(blob))::BIGINT AS bytes FROM content")
def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of the store."""
    one = contents(spark, sf_dir).groupBy(*BLOCK, "blob").agg(F.count("*").alias("n"), F.sum(F.length("blob")).alias("bytes"))
    per = one.groupBy(*BLOCK).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("bytes").alias("bytes"))
    return per.agg(F.count("*").alias("blocks"), F.sum("n").alias("addressed"), F.sum("k").alias("contents"), F.sum("bytes").alias("bytes"))


_IDS = _ROUNDED + ", ids AS (SELECT variable, time_id, y * 64 + x AS tile, md5(blob) AS blob FROM content)"


@query(_IDS + " SELECT variable, blob, min(tile)::BIGINT AS first_tile, count(*)::BIGINT AS run_length FROM (SELECT *, tile - row_number() OVER (PARTITION BY variable, blob ORDER BY tile) AS island FROM ids) GROUP BY variable, blob, island")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring tiles with the same content fold into runs (gaps and islands)."""
    ids = contents(spark, sf_dir).select("variable", (F.col("y") * 64 + F.col("x")).alias("tile"), F.md5("blob").alias("blob"))
    w = Window.partitionBy("variable", "blob").orderBy("tile")
    return ids.withColumn("island", F.col("tile") - F.row_number().over(w)).groupBy("variable", "blob", "island").agg(F.min("tile").alias("first_tile"), F.count("*").alias("run_length")).drop("island")


_DIR = "directory AS (SELECT k AS entry, k * 7 AS tile_id, CASE WHEN k % 3 = 0 THEN 7 ELSE 1 + k % 5 END AS run_length, 100 + k % 9 AS length FROM (SELECT unnest(range(300)) AS k))"


def directory(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(300).select(k.alias("entry"), (k * 7).alias("tile_id"), F.when(k % 3 == 0, 7).otherwise(1 + k % 5).cast("long").alias("run_length"), (100 + k % 9).alias("length"))


@query(f"WITH {_DIR} SELECT entry, tile_id + unnest(range(run_length)) AS tile FROM directory")
def run_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run as its single tiles."""
    return directory(spark).select("entry", F.explode(F.expr("sequence(tile_id, tile_id + run_length - 1)")).alias("tile"))


@query(f"WITH {_DIR} SELECT e.vec_id, d.entry, d.length FROM embeddings e LEFT JOIN directory d ON e.vec_id * 3 >= d.tile_id AND e.vec_id * 3 < d.tile_id + d.run_length")
def directory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval join made an equi-join: runs are cut at multiples of a bucket, and tiles meet them in theirs."""
    bucket = 16
    d = directory(spark).withColumn("b", F.explode(F.expr(f"sequence(tile_id DIV {bucket}, (tile_id + run_length - 1) DIV {bucket})")))
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("vec_id") * 3).alias("t")).withColumn("b", F.expr(f"t DIV {bucket}"))
    hit = (t["b"] == d["b"]) & (t["t"] >= d["tile_id"]) & (t["t"] < d["tile_id"] + d["run_length"])
    return t.join(d, hit, "left").select("vec_id", "entry", "length")


@query("WITH " + TILES_SQL + " SELECT variable, time_id, x, y, round(min(value::DOUBLE), 6) AS lo, round(max(value::DOUBLE), 6) AS hi, min(floor(value::DOUBLE)) = max(floor(value::DOUBLE)) AS constant FROM tiles GROUP BY variable, time_id, x, y")
def constant_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's range and whether its codes are all one; within the row, without unfolding."""
    floors = F.transform("pixels", lambda v: F.floor(v.cast("double")))
    t = tile_arrays(spark, sf_dir)
    return t.select(*BLOCK, "x", "y", F.round(F.array_min("pixels").cast("double"), 6).alias("lo"), F.round(F.array_max("pixels").cast("double"), 6).alias("hi"), (F.array_min(floors) == F.array_max(floors)).alias("constant"))


@query("WITH " + TILES_SQL + " SELECT variable, time_id, z, x // 2 AS x, y, py, px // 2 AS px, round(avg(value::DOUBLE), 6) AS value FROM tiles GROUP BY ALL".replace("x // 2 AS x, y, py, px // 2", "x, y, py // 2 AS py, px // 2"))
def downsample_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 2 x 2 pixels over those present; within each tile's row."""
    at = lambda i, j: F.get("pixels", i * 8 + j).cast("double")
    half = F.expr("sequence(0, 15)")

    def mean(k: Column) -> Column:
        r, c = F.expr("0") + F.floor(k / 4).cast("int") * 2, (k % 4) * 2
        four = F.filter(F.array(at(r, c), at(r, c + 1), at(r + 1, c), at(r + 1, c + 1)), lambda v: v.isNotNull())
        return F.aggregate(four, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(four), F.lit(0))

    t = tile_arrays(spark, sf_dir).select(*BLOCK, "z", "x", "y", F.posexplode(F.transform(half, mean)).alias("k", "value"))
    return t.select(*BLOCK, "z", "x", "y", F.expr("k DIV 4").alias("py"), (F.col("k") % 4).alias("px"), F.round("value", 6).alias("value"))


@query("WITH " + TILES_SQL + ", q AS (SELECT *, floor(value::DOUBLE * 100 + 0.5)::INT + 128 AS q FROM tiles) SELECT variable, time_id, x, y, py, px, ((q - coalesce(lag(q) OVER (PARTITION BY variable, time_id, x, y, px ORDER BY py), 0)) % 256 + 256) % 256 AS residual FROM q")
def delta_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code less the one above, modulo the code's width; within each tile's row."""
    q = F.transform("pixels", lambda v: F.floor(v.cast("double") * 100 + 0.5).cast("int") + 128)
    t = tile_arrays(spark, sf_dir).select(*BLOCK, "x", "y", q.alias("q"))
    res = F.transform("q", lambda v, i: F.pmod(v - F.coalesce(F.get("q", i - 8), F.lit(0)), F.lit(256)))
    t = t.select(*BLOCK, "x", "y", F.posexplode(res).alias("k", "residual"))
    return t.select(*BLOCK, "x", "y", F.expr("k DIV 8").alias("py"), (F.col("k") % 8).alias("px"), "residual")


@query(
    "WITH "
    + TILES_SQL
    + """, q AS (SELECT *, floor(value::DOUBLE * 100 + 0.5)::INT + 128 AS q FROM tiles),
l AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY variable, time_id, x, y, py ORDER BY px), 0) AS west, coalesce(lag(q) OVER (PARTITION BY variable, time_id, x, y, px ORDER BY py), 0) AS north FROM q)
SELECT variable, time_id, x, y, py, px, ((q - west - north + coalesce(lag(west) OVER (PARTITION BY variable, time_id, x, y, px ORDER BY py), 0)) % 256 + 256) % 256 AS residual FROM l"""
)
def lorenzo_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code less what its west, north and north-west neighbours predict; within each tile's row, where windows would sort."""
    q = F.transform("pixels", lambda v: F.floor(v.cast("double") * 100 + 0.5).cast("int") + 128)
    t = tile_arrays(spark, sf_dir).select(*BLOCK, "x", "y", q.alias("q"))
    at = lambda i, ok: F.coalesce(F.when(ok, F.get("q", i)), F.lit(0))
    res = F.transform("q", lambda v, i: F.pmod(v - at(i - 1, i % 8 > 0) - at(i - 8, i >= 8) + at(i - 9, (i % 8 > 0) & (i >= 8)), F.lit(256)))
    t = t.select(*BLOCK, "x", "y", F.posexplode(res).alias("k", "residual"))
    return t.select(*BLOCK, "x", "y", F.expr("k DIV 8").alias("py"), (F.col("k") % 8).alias("px"), "residual")


@query("WITH " + TILES_SQL + ", q AS (SELECT *, floor(value::DOUBLE * 100 + 0.5)::INT + 128 AS q FROM tiles) SELECT variable, time_id, bit, sum((q >> bit) & 1)::BIGINT AS ones FROM q, (SELECT unnest(range(8)) AS bit) GROUP BY variable, time_id, bit")
def bitplane_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q09: set bits of each bit plane of a block; summed within the tile first, so few rows are grouped."""
    q = F.transform("pixels", lambda v: F.floor(v.cast("double") * 100 + 0.5).cast("int") + 128)
    t = tile_arrays(spark, sf_dir).select(*BLOCK, q.alias("q"))
    ones = lambda bit: F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + F.shiftright(v, bit).bitwiseAND(F.lit(1)))
    planes = F.array(*map(ones, range(8)))
    return t.select(*BLOCK, F.posexplode(planes).alias("bit", "k")).groupBy(*BLOCK, "bit").agg(F.sum("k").alias("ones")).withColumn("bit", F.col("bit").cast("long"))


@query("WITH " + GRID_SQL + ", s AS (SELECT variable, time_id, gy, gx, value, CASE WHEN (gy + gx + time_id) % 11 = 0 THEN NULL WHEN (gy * gx) % 7 = 0 THEN value + 0.25::DOUBLE ELSE value END AS stored FROM grid) SELECT variable, count(*) FILTER (WHERE value IS NOT NULL AND stored IS NOT NULL)::BIGINT AS finite, count(*) FILTER (WHERE value IS NULL AND stored IS NULL)::BIGINT AS both_missing, count(*) FILTER (WHERE value IS NOT NULL AND stored IS NULL)::BIGINT AS only_stored_missing, count(*) FILTER (WHERE value IS NULL AND stored IS NOT NULL)::BIGINT AS only_source_missing, count(*) FILTER (WHERE abs(stored - value) <= 0.1::DOUBLE)::BIGINT AS within, round(avg(abs(stored - value)), 6) AS mean_error, round(max(abs(stored - value)), 6) AS worst FROM s GROUP BY variable")
def compare_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against source cells, with the three ways a value can be missing."""
    s = grid(spark, sf_dir).withColumn("stored", F.when((F.col("gy") + F.col("gx") + F.col("time_id")) % 11 == 0, None).when((F.col("gy") * F.col("gx")) % 7 == 0, F.col("value") + 0.25).otherwise(F.col("value")))
    a, b, d = F.col("value").isNull(), F.col("stored").isNull(), F.abs(F.col("stored") - F.col("value"))
    return s.groupBy("variable").agg(F.count_if(~a & ~b).alias("finite"), F.count_if(a & b).alias("both_missing"), F.count_if(~a & b).alias("only_stored_missing"), F.count_if(a & ~b).alias("only_source_missing"), F.count_if(d <= 0.1).alias("within"), F.round(F.avg(d), 6).alias("mean_error"), F.round(F.max(d), 6).alias("worst"))


@query("WITH " + CELLS_SQL + " SELECT 'block without cells' AS rule, count(*) FILTER (WHERE n = 0)::BIGINT AS violations FROM (SELECT count(value) AS n FROM cells GROUP BY variable, time_id) UNION ALL SELECT 'cell off the grid', count(*) FILTER (WHERE gy NOT BETWEEN 0 AND 19 OR gx NOT BETWEEN 0 AND 19) FROM cells UNION ALL SELECT 'price below zero', count(*) FILTER (WHERE value < 0) FROM cells UNION ALL SELECT 'month out of range', count(*) FILTER (WHERE time_id NOT BETWEEN 1 AND 12) FROM cells")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """violations of each rule, counted in one pass and stacked."""
    from ..views import present_cells

    c = present_cells(spark, sf_dir)
    per = c.groupBy("variable", "time_id").agg(F.count("value").alias("n"), F.count_if(~F.col("gy").between(0, 19) | ~F.col("gx").between(0, 19)).alias("off"), F.count_if(F.col("value") < 0).alias("neg"))
    one = per.agg(F.count_if(F.col("n") == 0).alias("a"), F.sum("off").alias("b"), F.sum("neg").alias("c"), F.coalesce(F.sum(F.when(~F.col("time_id").between(1, 12), F.col("n"))), F.lit(0)).alias("d"))
    return one.select(F.expr("stack(4, 'block without cells', a, 'cell off the grid', b, 'price below zero', c, 'month out of range', d) AS (rule, violations)"))


@query("WITH " + TILES_SQL + ", t AS (SELECT DISTINCT variable, time_id, x, y FROM tiles) SELECT variable, x >> 2 AS px4, y >> 2 AS py4, count(*)::BIGINT AS children FROM t GROUP BY ALL")
def ancestor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles below each ancestor two zooms up."""
    return tile_arrays(spark, sf_dir).groupBy("variable", F.shiftright("x", 2).alias("px4"), F.shiftright("y", 2).alias("py4")).agg(F.count("*").alias("children"))


@query("WITH " + TILES_SQL + ", t AS (SELECT DISTINCT variable, x, y FROM tiles), have AS (SELECT variable, z, x >> (6 - z) AS x, y >> (6 - z) AS y FROM t, (SELECT unnest([6, 4, 2]) AS z) WHERE (variable + x) % z <> 1 GROUP BY ALL), w AS (SELECT vec_id, vec_id % 64 AS x, vec_id // 64 AS y FROM embeddings) SELECT vec_id, v.variable, max(h.z) AS found_z FROM w CROSS JOIN (SELECT DISTINCT variable FROM t) v LEFT JOIN have h ON h.variable = v.variable AND h.x = w.x >> (6 - h.z) AND h.y = w.y >> (6 - h.z) GROUP BY vec_id, v.variable")
def parent_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest stored ancestor of each wanted tile: ancestors are unfolded (three a tile) and joined by equality."""
    zs = F.array(F.lit(6), F.lit(4), F.lit(2))
    up = lambda c: F.call_function("shiftright", F.col(c), 6 - F.col("z"))
    have = tile_arrays(spark, sf_dir).select("variable", "x", "y").distinct().withColumn("z", F.explode(zs)).filter((F.col("variable") + F.col("x")) % F.col("z") != 1)
    have = have.select("variable", "z", up("x").alias("ax"), up("y").alias("ay")).distinct()
    want = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 64).alias("x"), F.expr("vec_id DIV 64").alias("y"))
    names = tile_arrays(spark, sf_dir).agg(F.collect_set("variable")).scalar()  # a dimension: one row
    want = want.withColumn("variable", F.explode(names)).withColumn("z", F.explode(zs)).select("vec_id", "variable", "z", up("x").alias("ax"), up("y").alias("ay"))
    got = want.join(have.withColumn("hit", F.col("z")), ["variable", "z", "ax", "ay"], "left")
    return got.groupBy("vec_id", "variable").agg(F.max("hit").alias("found_z"))


@query("WITH " + TILES_SQL + " SELECT variable, count(*) FILTER (WHERE value IS NOT NULL)::BIGINT AS present, round(min(value::DOUBLE), 6) AS vmin, round(max(value::DOUBLE), 6) AS vmax, count(DISTINCT time_id)::BIGINT AS steps FROM tiles GROUP BY variable")
def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables with their range over all blocks, from the blocks' ranges."""
    b = block_params(tiles(spark, sf_dir))
    return b.groupBy("variable").agg(F.sum("n").alias("present"), F.round(F.min("vmin"), 6).alias("vmin"), F.round(F.max("vmax"), 6).alias("vmax"), F.count("*").alias("steps"))


def by_tile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_arrays(spark, sf_dir).withColumn("tile_id", tile_id(F.col("z"), F.col("x"), F.col("y")))
