"""Queries over the counts, chunks and codes of encoding runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..views import CELLS_SQL, GRID_SQL, OBS_SQL, TILES_SQL, grid, obs, present_cells, table, tile_arrays


def varint_length(v: Column) -> Column:
    """Bytes of an unsigned number in base 128, of 63 bits at most."""
    return F.greatest(F.ceil(F.length(F.bin(v)) / 7), F.lit(1)).cast("int")


@query("SELECT o_orderkey, v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 WHEN v < 34359738368 THEN 5 WHEN v < 4398046511104 THEN 6 WHEN v < 562949953421312 THEN 7 ELSE 8 END AS bytes FROM (SELECT o_orderkey, (o_orderkey * o_custkey) % (1::BIGINT << (o_orderkey % 50)::INT) AS v FROM orders)")
def varint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: encoded lengths."""
    v = F.col("o_orderkey") * F.col("o_custkey") % F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("o_orderkey") % 50).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).withColumn("bytes", varint_length(F.col("v")))


@query(f"WITH {OBS_SQL} SELECT variable, count(*)::BIGINT AS messages, count(*) FILTER (WHERE value > 20)::BIGINT AS kept, count(DISTINCT ts)::BIGINT AS steps FROM obs GROUP BY ROLLUP (variable)")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and kept ones, of each variable and of all."""
    return obs(spark, sf_dir).rollup("variable").agg(F.count("*").alias("messages"), F.count_if(F.col("value") > 20).alias("kept"), F.count_distinct("ts").alias("steps"))


@query(f"WITH {OBS_SQL} SELECT variable, count(*)::BIGINT AS n FROM obs WHERE variable IN ('click', 'view', 'error') GROUP BY variable")
def variable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages of the wanted variables; the filter reaches the scan."""
    return obs(spark, sf_dir).filter(F.col("variable").isin("click", "view", "error")).groupBy("variable").agg(F.count("*").alias("n"))


@query(f"WITH {OBS_SQL}, axis AS (SELECT DISTINCT ts FROM obs WHERE variable = 'error') SELECT variable, count(*)::BIGINT AS n, count(*) FILTER (WHERE ts IN (SELECT ts FROM axis))::BIGINT AS on_axis FROM obs GROUP BY variable")
def axis_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations whose time the axis has; the axis is joined by equality on distinct times."""
    o = obs(spark, sf_dir)
    axis = o.filter("variable = 'error'").select("ts").distinct().withColumn("hit", F.lit(True))
    return o.join(axis, "ts", "left").groupBy("variable").agg(F.count("*").alias("n"), F.count("hit").alias("on_axis"))


@query(f"WITH {GRID_SQL}, m AS (SELECT variable, time_id, gy, gx, CASE WHEN time_id % 4 = 1 THEN NULL ELSE value END AS value FROM grid) SELECT variable, time_id, count(value)::BIGINT AS n FROM m GROUP BY ALL HAVING count(value) > 0")
def present_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks with any value."""
    m = grid(spark, sf_dir).withColumn("value", F.when(F.col("time_id") % 4 != 1, F.col("value")))
    return m.groupBy("variable", "time_id").agg(F.count("value").alias("n")).filter("n > 0")


@query(f"WITH {TILES_SQL} SELECT variable, time_id, count(*)::BIGINT AS n, count(CASE WHEN value < 0 THEN NULL ELSE value END)::BIGINT AS present FROM tiles GROUP BY ALL")
def nodata_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells left after masking (here: values below zero); counted within the tile."""
    t = tile_arrays(spark, sf_dir).select("variable", "time_id", F.size("pixels").alias("n"), F.size(F.filter("pixels", lambda v: v >= 0)).alias("p"))
    return t.groupBy("variable", "time_id").agg(F.sum("n").alias("n"), F.sum("p").alias("present"))


@query(f"WITH {CELLS_SQL}, b AS (SELECT variable, time_id, min(value) AS lo, max(value) AS hi FROM cells GROUP BY ALL) SELECT variable, round(min(lo), 4) AS lo, round(max(hi), 4) AS hi, count(*) FILTER (WHERE hi > 95000)::BIGINT AS blocks_above FROM b GROUP BY variable")
def block_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of blocks, and what block ranges alone tell: blocks that can hold a value above a bound."""
    b = present_cells(spark, sf_dir).groupBy("variable", "time_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return b.groupBy("variable").agg(F.round(F.min("lo"), 4).alias("lo"), F.round(F.max("hi"), 4).alias("hi"), F.count_if(F.col("hi") > 95000).alias("blocks_above"))


@query("SELECT event_id, round(r + x * pow(2.0::DOUBLE, e) * pow(10.0::DOUBLE, -d), 6) AS value FROM (SELECT event_id, 250.5::DOUBLE * pow(10.0::DOUBLE, -(event_id % 3)) AS r, (user_id * 31) % 4096 AS x, (event_id % 7) - 3 AS e, event_id % 3 AS d FROM events)")
def simple_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple packing: reference and scaled integers."""
    from ..sources.grib import unpacked

    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(unpacked(F.col("user_id") * 31 % 4096, F.lit(250.5), F.col("event_id") % 7 - 3, F.col("event_id") % 3), 6).alias("value"))


@query(f"WITH {GRID_SQL}, c AS (SELECT variable, time_id, gx // 5 AS cx, gy // 5 AS cy, string_agg(coalesce(floor(value / 20000)::INT::VARCHAR, '-'), '' ORDER BY gy, gx) AS blob FROM grid GROUP BY ALL) SELECT variable, count(*)::BIGINT AS chunks, count(DISTINCT blob)::BIGINT AS contents, sum(length(blob))::BIGINT AS bytes FROM c GROUP BY variable")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the raw grid with equal contents."""
    code = F.coalesce(F.floor(F.col("value") / 20000).cast("int").cast("string"), F.lit("-"))
    g = grid(spark, sf_dir).select("variable", "time_id", F.expr("gx DIV 5").alias("cx"), F.expr("gy DIV 5").alias("cy"), F.struct("gy", "gx", code.alias("c")).alias("s"))
    c = g.groupBy("variable", "time_id", "cx", "cy").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]), "").alias("blob"))
    per = c.groupBy("variable", "blob").agg(F.count("*").alias("n"))
    return per.groupBy("variable").agg(F.sum("n").alias("chunks"), F.count("*").alias("contents"), F.sum(F.col("n") * F.length("blob")).alias("bytes"))


@query(f"WITH {TILES_SQL} SELECT variable, time_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(DISTINCT (x, y))::BIGINT AS tiles FROM tiles GROUP BY ALL")
def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each block."""
    t = tile_arrays(spark, sf_dir)
    return t.groupBy("variable", "time_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("tiles"))


@query(f"WITH {TILES_SQL}, r AS (SELECT (vec_id % 500) // 5 AS a, vec_id, label AS variable, vec_id // 50 AS time_id FROM embeddings) SELECT vec_id, r.variable, r.time_id, b.n FROM r LEFT JOIN (SELECT variable, time_id, count(*)::BIGINT AS n FROM tiles GROUP BY ALL) b ON b.variable = (r.variable + 1) % 12 AND b.time_id = r.time_id")
def block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by (variable, time); unknown ones give null."""
    t = tile_arrays(spark, sf_dir)
    b = t.groupBy(F.col("variable").alias("bv"), F.col("time_id").alias("bt")).agg(F.sum(F.size("pixels")).alias("n"))
    r = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("variable"), F.expr("vec_id DIV 50").alias("time_id"))
    return r.join(b, ((r["variable"] + 1) % 12 == b["bv"]) & (r["time_id"] == b["bt"]), "left").select("vec_id", "variable", "time_id", "n")


@query(f"WITH {TILES_SQL} SELECT label AS variable, vec_id, round(embedding[((vec_id * 3) % 8) * 8 + (vec_id * 5) % 8 + 1]::DOUBLE, 6) AS value FROM embeddings")
def pixel_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel of each tile by row and column, without unfolding the tile."""
    at = (F.col("vec_id") * 3 % 8 * 8 + F.col("vec_id") * 5 % 8 + 1).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("variable"), "vec_id", F.round(F.element_at("embedding", at).cast("double"), 6).alias("value"))


@query("SELECT event_type, count(*)::BIGINT AS n, min(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS lo, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS hi, count(DISTINCT json_extract_string(props, '$.k'))::BIGINT AS kinds FROM events GROUP BY event_type")
def metadata_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a JSON metadata map."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(k.cast("long")).alias("lo"), F.max(k.cast("long")).alias("hi"), F.count_distinct(k).alias("kinds"))


@query("SELECT s_suppkey, x, i::INT AS below, round((v - lo) / (hi - lo) + i - 1, 6) AS position FROM (SELECT s_suppkey, s_acctbal AS x, s_acctbal AS v, i, a[i] AS lo, a[i + 1] AS hi FROM supplier, (SELECT [-1000.0::DOUBLE, 0, 500, 2000, 4500, 7000, 12000] AS a), (SELECT unnest(range(1, 7)) AS i)) WHERE v >= lo AND v < hi")
def axis_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fractional index of a value on an uneven axis; the axis is an array, searched within the row."""
    axis = F.array(*(F.lit(float(a)) for a in (-1000, 0, 500, 2000, 4500, 7000, 12000)))
    x = F.col("s_acctbal")
    i = F.size(F.filter(axis, lambda a: a <= x))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"), i.alias("below"), axis.alias("a")).filter("below BETWEEN 1 AND 6")
    lo, hi = F.element_at("a", F.col("below")), F.element_at("a", F.col("below") + 1)
    return s.select("s_suppkey", "x", "below", F.round((F.col("x") - lo) / (hi - lo) + F.col("below") - 1, 6).alias("position"))


@query(f"WITH {CELLS_SQL}, p AS (SELECT variable, time_id, gy, gx, value, sum(value) OVER (PARTITION BY variable, time_id, gy ORDER BY gx) AS r FROM cells) SELECT variable, time_id, gy, gx, round(r, 2) AS running FROM p")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums along rows, as decoding differences takes them."""
    from pyspark.sql import Window

    c = present_cells(spark, sf_dir)
    w = Window.partitionBy("variable", "time_id", "gy").orderBy("gx")
    return c.select("variable", "time_id", "gy", "gx", F.round(F.sum("value").over(w), 2).alias("running"))
