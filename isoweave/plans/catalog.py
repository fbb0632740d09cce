"""Queries over catalogs: time axes, blocks, snapshots, appends, set operations and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.coalesce import coalesce_greedy as greedy_groups
from ..registry import query
from ..views import CELLS_SQL, OBS_SQL, TILES_SQL, obs, present_cells, table, tile_arrays


def axis_of(times: DataFrame) -> DataFrame:
    """ts, time_id of the distinct times in order. The axis is a dimension: distinct times, whatever the data's size.

    Ranks come from the sorted distinct times gathered in one row, so that no window runs without a partition.
    """
    one = times.select("ts").distinct().agg(F.array_sort(F.collect_list("ts")).alias("t"))
    return one.select(F.posexplode("t").alias("time_id", "ts")).select("ts", F.col("time_id").cast("long").alias("time_id"))


_AXIS = f"WITH {OBS_SQL}, axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS time_id FROM (SELECT DISTINCT ts FROM obs))"


@query(_AXIS + " SELECT time_id, ts, epoch_ms(ts) AS ts_ms FROM axis")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct times in order with their ids."""
    return axis_of(obs(spark, sf_dir).select("ts")).select("time_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


@query(f"WITH {OBS_SQL}, a AS (SELECT DISTINCT variable, ts FROM obs WHERE variable <> 'error' OR hour(ts) % 2 = 0), d AS (SELECT variable, ts, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY variable ORDER BY ts)) AS step FROM a) SELECT variable, count(*)::BIGINT AS steps, count(DISTINCT step) <= 1 AS regular, CASE WHEN count(*) = 1 THEN 0 WHEN count(DISTINCT step) = 1 THEN min(step) END::BIGINT AS interval_ms FROM d GROUP BY variable")
def axis_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a variable's axis is regular, and its interval."""
    a = obs(spark, sf_dir).select("variable", "ts").filter("variable != 'error' OR hour(ts) % 2 = 0").distinct().withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    d = a.withColumn("step", F.col("ms") - F.lag("ms").over(Window.partitionBy("variable").orderBy("ms")))
    kinds = F.count_distinct("step")
    return d.groupBy("variable").agg(F.count("*").alias("steps"), (kinds <= 1).alias("regular"), F.when(F.count("*") == 1, 0).when(kinds == 1, F.min("step")).alias("interval_ms"))


@query(_AXIS + " SELECT e.event_id, a.time_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts ELSE date_trunc('hour', ts) END AS t FROM events) e LEFT JOIN axis a ON a.ts = e.t")
def time_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of each time, null if the axis hasn't exactly that time."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).otherwise(F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("ts"))
    return e.join(axis_of(obs(spark, sf_dir).select("ts")), "ts", "left").select("event_id", "time_id")


@query(_AXIS + ", d AS (SELECT time_id, epoch_ms(ts) - coalesce(lag(epoch_ms(ts)) OVER (ORDER BY ts), 0) AS delta FROM axis) SELECT time_id, delta, xor(delta << 1, delta >> 63) AS zigzag FROM d")
def time_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zigzag-coded differences of times, within the axis' one row."""
    one = obs(spark, sf_dir).select("ts").distinct().agg(F.array_sort(F.collect_list(F.unix_millis(F.col("ts").cast("timestamp")))).alias("t"))
    d = one.select(F.posexplode(F.transform("t", lambda v, i: v - F.coalesce(F.get("t", i - 1), F.lit(0)))).alias("time_id", "delta"))
    return d.select(F.col("time_id").cast("long").alias("time_id"), "delta", F.shiftleft("delta", 1).bitwiseXOR(F.shiftright("delta", 63)).alias("zigzag"))


_KEYS = "k AS (SELECT DISTINCT o_custkey % 50 AS variable, (o_custkey % 50) << 32 | (o_orderkey % 1000) AS key FROM orders)"


@query(f"WITH {_KEYS}, d AS (SELECT variable, key, key - coalesce(lag(key) OVER (PARTITION BY variable ORDER BY key), 0) AS delta FROM k) SELECT variable, key, delta, sum(delta) OVER (PARTITION BY variable ORDER BY key ROWS UNBOUNDED PRECEDING)::BIGINT AS decoded FROM d")
def key_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of sorted block keys, and their running sum, which is the key again."""
    from ..functions.addressing import block_key

    v = F.col("o_custkey") % 50
    k = table(spark, sf_dir, "orders").select(v.alias("variable"), block_key(v, F.col("o_orderkey") % 1000).alias("key")).distinct()
    w = Window.partitionBy("variable").orderBy("key")
    d = k.withColumn("delta", F.col("key") - F.lag("key", 1, 0).over(w))
    return d.withColumn("decoded", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))


_BLOBS = "b AS (SELECT l_suppkey AS block, l_orderkey * 10 + l_linenumber AS tile, 10 + l_quantity::BIGINT AS length, row_number() OVER (PARTITION BY l_suppkey, l_orderkey * 10 + l_linenumber ORDER BY l_partkey) AS r FROM lineitem)"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("block"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tile"), (10 + F.col("l_quantity").cast("long")).alias("length"), "l_partkey")
    return rows.groupBy("block", "tile").agg(F.min_by("length", F.struct("l_partkey", "length")).alias("length"))


@query(
    _BLOBS.join(["WITH ", ", u AS (SELECT block, tile, arg_min(length, l) AS length FROM (SELECT b.*, 0 AS l FROM b WHERE r = 1) GROUP BY ALL)"]).replace("ORDER BY l_partkey", "ORDER BY l_partkey, l_quantity")
    + ", o AS (SELECT block, tile, length, coalesce(sum(length) OVER (PARTITION BY block ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + (CASE WHEN tile % 17 = 0 THEN 1000000 ELSE 0 END) AS off FROM u), p AS (SELECT *, lag(off + length) OVER (PARTITION BY block ORDER BY tile) AS prev_end FROM o) SELECT block, tile, length, off, CASE WHEN off = prev_end THEN 0 ELSE off + 1 END AS coded FROM p"
)
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets from lengths, and their implicit form: 0 where a blob follows the one before."""
    w = Window.partitionBy("block").orderBy("tile")
    o = blobs(spark, sf_dir).withColumn("off", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.when(F.col("tile") % 17 == 0, 1000000).otherwise(0))
    p = o.withColumn("prev_end", F.lag(F.col("off") + F.col("length")).over(w))
    return p.select("block", "tile", "length", "off", F.when(F.col("off") == F.col("prev_end"), 0).otherwise(F.col("off") + 1).alias("coded"))


@query("WITH s AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n, l_orderkey FROM lineitem) SELECT l_suppkey, k // (ceil(sqrt(n))::BIGINT) AS leaf, count(*)::BIGINT AS entries, min(l_orderkey) AS first_key FROM s GROUP BY ALL")
def index_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted entries in leaves of about the square root of their number."""
    w = Window.partitionBy("l_suppkey")
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    leaf = F.expr("cast(k AS BIGINT) DIV cast(ceil(sqrt(n)) AS BIGINT)")
    return s.groupBy("l_suppkey", leaf.alias("leaf")).agg(F.count("*").alias("entries"), F.min("l_orderkey").alias("first_key"))


# ---------------------------------------------------------------- appends and snapshots

_GENERATIONS = "g AS (SELECT (l_suppkey % 7)::INT AS generation, l_returnflag AS variable, month(l_shipdate)::INT AS time_id, max(l_extendedprice) AS vmax, count(*)::BIGINT AS n FROM lineitem WHERE (l_suppkey % 7) * 2 >= month(l_shipdate) - 3 GROUP BY ALL)"


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block rows of successive appends, each tagged with its generation."""
    li = table(spark, sf_dir, "lineitem").withColumn("m", F.month("l_shipdate")).filter("(l_suppkey % 7) * 2 >= m - 3")
    return li.groupBy((F.col("l_suppkey") % 7).cast("int").alias("generation"), F.col("l_returnflag").alias("variable"), F.col("m").alias("time_id")).agg(F.max("l_extendedprice").alias("vmax"), F.count("*").alias("n"))


def newest(blocks: DataFrame, upto: int | None = None) -> DataFrame:
    """The block table as of a generation: of each key the row of the newest one. A maximum of a struct, combined before the shuffle."""
    rows = blocks if upto is None else blocks.filter(F.col("generation") <= upto)
    rest = [c for c in blocks.columns if c not in ("variable", "time_id", "generation")]
    return rows.groupBy("variable", "time_id").agg(F.max_by(F.struct("generation", *rest), "generation").alias("r")).select("variable", "time_id", "r.*")


@query(f"WITH {_GENERATIONS} SELECT variable, time_id, generation, vmax, n FROM g QUALIFY row_number() OVER (PARTITION BY variable, time_id ORDER BY generation DESC) = 1")
def block_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new block tables merged, new rows win."""
    return newest(generations(spark, sf_dir))


@query(f"WITH {_GENERATIONS} SELECT s AS snapshot, variable, time_id, generation, n FROM g, (SELECT unnest([2, 4]) AS s) WHERE generation <= s QUALIFY row_number() OVER (PARTITION BY s, variable, time_id ORDER BY generation DESC) = 1")
def snapshot_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block table as two earlier generations saw it."""
    g = generations(spark, sf_dir)
    return newest(g, 2).withColumn("snapshot", F.lit(2)).unionByName(newest(g, 4).withColumn("snapshot", F.lit(4))).drop("vmax")


@query(f"WITH {_GENERATIONS}, h AS (SELECT generation, count(*)::BIGINT AS blocks, sum(n)::BIGINT AS entries, generation % 3 <> 2 AS valid FROM g GROUP BY generation) SELECT generation, lag(generation) OVER (ORDER BY generation) AS previous, blocks, entries, valid, generation = (SELECT max(generation) FROM h WHERE valid) AS active FROM h")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with the one before; the newest valid one is active. One row a generation."""
    h = generations(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("blocks"), F.sum("n").alias("entries")).withColumn("valid", F.col("generation") % 3 != 2)
    one = h.agg(F.array_sort(F.collect_list(F.struct("generation", "blocks", "entries", "valid"))).alias("h"))
    active = F.array_max(F.transform(F.filter("h", lambda s: s["valid"]), lambda s: s["generation"]))
    rows = one.select("h", active.alias("active_id"), F.posexplode("h").alias("i", "s"))
    return rows.select("s.generation", F.get("h", F.col("i") - 1)["generation"].alias("previous"), "s.blocks", "s.entries", "s.valid", (F.col("s.generation") == F.col("active_id")).alias("active"))


@query(f"WITH {_GENERATIONS} SELECT generation, count(*)::BIGINT AS submitted, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM g o WHERE o.variable = g.variable AND o.time_id = g.time_id AND o.generation < g.generation))::BIGINT AS already_present FROM g GROUP BY generation")
def already_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each append, how many blocks were there before."""
    g = generations(spark, sf_dir)
    first = g.groupBy("variable", "time_id").agg(F.min("generation").alias("first"))
    return g.join(first, ["variable", "time_id"]).groupBy("generation").agg(F.count("*").alias("submitted"), F.count_if(F.col("first") < F.col("generation")).alias("already_present"))


_LATE = f"WITH {OBS_SQL}, base AS (SELECT DISTINCT ts FROM obs WHERE day(ts) BETWEEN 5 AND 20 AND hour(ts) % 2 = 0), fresh AS (SELECT variable, ts, count(*)::BIGINT AS n FROM obs GROUP BY ALL)"


@query(_LATE + " SELECT f.variable, f.ts, f.n, CASE WHEN f.ts IN (SELECT ts FROM base) THEN 'reuse' WHEN f.ts < (SELECT max(ts) FROM base) THEN 'late' ELSE 'append' END AS fate FROM fresh f")
def late_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of an append: known ones are reused, later ones appended, earlier unknown ones are late."""
    o = obs(spark, sf_dir)
    base = o.filter("day(ts) BETWEEN 5 AND 20 AND hour(ts) % 2 = 0").select("ts").distinct()
    last = base.agg(F.max("ts")).scalar()
    fresh = o.groupBy("variable", "ts").agg(F.count("*").alias("n"))
    out = fresh.join(base.withColumn("known", F.lit(True)), "ts", "left")
    return out.select("variable", "ts", "n", F.when(F.col("known"), "reuse").when(F.col("ts") < last, "late").otherwise("append").alias("fate"))


@query(f"WITH {CELLS_SQL}, d AS (SELECT variable, time_id, gy, gx, row_number() OVER (PARTITION BY variable, gy, gx ORDER BY value DESC, time_id) AS r, count(*) OVER (PARTITION BY variable, gy, gx) AS n FROM cells) SELECT variable, gy, gx, time_id AS kept, n - 1 AS dropped FROM d WHERE r = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of a key: the first stays (here the highest value), the others are counted."""
    c = present_cells(spark, sf_dir)
    best = F.max_by("time_id", F.struct("value", -F.col("time_id")))
    return c.groupBy("variable", "gy", "gx").agg(best.alias("kept"), (F.count("*") - 1).alias("dropped"))


@query(f"WITH {CELLS_SQL}, s AS (SELECT DISTINCT variable, time_id, gy FROM cells WHERE gx < 10 AND value > 90000), t AS (SELECT DISTINCT variable, time_id, gy FROM cells WHERE gx >= 10 AND value > 90000) SELECT 'union' AS op, * FROM (SELECT * FROM s UNION SELECT * FROM t) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM s INTERSECT SELECT * FROM t) UNION ALL SELECT 'except', * FROM (SELECT * FROM s EXCEPT SELECT * FROM t)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of blocks with high values in the west and in the east half, as two inputs: all, shared and missing ones. One grouping answers all three."""
    c = present_cells(spark, sf_dir).filter("value > 90000")
    k = c.groupBy("variable", "time_id", "gy").agg(F.bool_or(F.col("gx") < 10).alias("s"), F.bool_or(F.col("gx") >= 10).alias("t"))
    ops = F.array_compact(F.array(F.lit("union"), F.when(F.col("s") & F.col("t"), "intersect"), F.when(F.col("s") & ~F.col("t"), "except")))
    return k.select(F.explode(ops).alias("op"), "variable", "time_id", "gy")


@query(f"WITH {TILES_SQL}, need AS (SELECT DISTINCT variable, x // 4 AS cx, y // 4 AS cy FROM tiles), cached AS (SELECT DISTINCT variable + 1 AS variable, x // 4 AS cx, y // 4 AS cy FROM tiles) SELECT * FROM need EXCEPT SELECT * FROM cached")
def chunk_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct coarse cells of each variable that the variable before doesn't hold yet."""
    t = tile_arrays(spark, sf_dir).select("variable", F.expr("x DIV 4").alias("cx"), F.expr("y DIV 4").alias("cy")).distinct()
    return t.join(t.withColumn("variable", F.col("variable") + 1), ["variable", "cx", "cy"], "left_anti")


@query(f"WITH {OBS_SQL}, s AS (SELECT DISTINCT ts FROM obs WHERE variable = 'click'), t AS (SELECT DISTINCT ts FROM obs WHERE variable = 'error') SELECT ts FROM (SELECT * FROM s EXCEPT SELECT * FROM t) ORDER BY ts LIMIT 10")
def unmatched_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten times that only one of two inputs has; the limit is the feature."""
    o = obs(spark, sf_dir)
    return o.filter("variable = 'click'").select("ts").distinct().join(o.filter("variable = 'error'").select("ts").distinct(), "ts", "left_anti").orderBy("ts").limit(10)


# ---------------------------------------------------------------- ranges

_RANGES = "r AS (SELECT l_suppkey AS file, (l_orderkey * 4096 + l_linenumber * 512 + l_partkey) AS off, 64 + l_quantity::BIGINT * 40 AS len FROM lineitem)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 4096 + F.col("l_linenumber") * 512 + F.col("l_partkey")).alias("off"), (64 + F.col("l_quantity").cast("long") * 40).alias("len"))


@query(f"WITH {_RANGES}, e AS (SELECT *, max(off + len) OVER (PARTITION BY file ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r), g AS (SELECT *, sum(CASE WHEN prev IS NULL OR off - prev > 8192 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY off, len ROWS UNBOUNDED PRECEDING) AS grp FROM e) SELECT file, min(off) AS start_, max(off + len) AS end_, count(*)::BIGINT AS members FROM g GROUP BY file, grp")
def coalesce_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges joined over small gaps (sessions of offsets)."""
    w = Window.partitionBy("file").orderBy("off", "len")
    e = ranges(spark, sf_dir).withColumn("prev", F.max(F.col("off") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new: Column = F.when(F.col("prev").isNull() | (F.col("off") - F.col("prev") > 8192), 1).otherwise(0)
    g = e.withColumn("grp", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("file", "grp").agg(F.min("off").alias("start_"), F.max(F.col("off") + F.col("len")).alias("end_"), F.count("*").alias("members")).drop("grp")


@query(
    f"WITH RECURSIVE {_RANGES}, s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY off, len) AS i FROM r), f AS (SELECT file, i, off AS start_, off + len AS end_, 1::BIGINT AS grp FROM s WHERE i = 1 UNION ALL "
    "SELECT s.file, s.i, CASE WHEN j THEN f.start_ ELSE s.off END, CASE WHEN j THEN greatest(f.end_, s.off + s.len) ELSE s.off + s.len END, CASE WHEN j THEN f.grp ELSE f.grp + 1 END FROM (SELECT f.*, greatest(0, s2.off - f.end_) <= 65536 AND greatest(f.end_, s2.off + s2.len) - f.start_ <= 1048576 AS j FROM f JOIN s s2 ON s2.file = f.file AND s2.i = f.i + 1) f JOIN s ON s.file = f.file AND s.i = f.i + 1) "
    "SELECT file, start_, max(end_) AS end_, count(*)::BIGINT AS members FROM f GROUP BY file, grp, start_"
)
def coalesce_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy groups bounded by gap and span; in order, so each file's ranges are streamed sorted through a task."""
    return greedy_groups(ranges(spark, sf_dir), gap=65536, span=1048576)
