"""Queries over names, levels, times and units of source records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..registry import query
from ..views import table

_SANE = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"SELECT p_partkey, {_SANE.format('p_name')} AS name, {_SANE.format('p_type')} AS kind FROM part")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of letters, digits and single underscores."""
    return table(spark, sf_dir, "part").select("p_partkey", N.sanitized(F.col("p_name")).alias("name"), N.sanitized(F.col("p_type")).alias("kind"))


@query(f"WITH n AS (SELECT p_partkey, {_SANE.format('p_brand')} AS name FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY name) AS k, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS r FROM n) SELECT p_partkey, CASE WHEN k > 1 THEN name || '_' || r::VARCHAR ELSE name END AS name FROM c")
def name_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that collide get a suffix in order."""
    w = Window.partitionBy("name")
    n = table(spark, sf_dir, "part").select("p_partkey", N.sanitized(F.col("p_brand")).alias("name"))
    c = n.select("*", F.count("*").over(w).alias("k"), F.row_number().over(w.orderBy("p_partkey")).alias("r"))
    return c.select("p_partkey", F.when(F.col("k") > 1, F.concat_ws("_", "name", F.col("r").cast("string"))).otherwise(F.col("name")).alias("name"))


_LEVELS = ["surface", "isobaricInhPa", "heightAboveGround", "depthBelowLandLayer", "tropopause", "potentialVorticity", "hybrid", "cloudBase", "mySpecial Level", "sigmaLayer"]
_LEVEL_SQL = "lv AS (SELECT l_orderkey, l_linenumber, l_partkey, [" + ", ".join(f"'{x}'" for x in _LEVELS) + "][(l_partkey % 10 + 1)::INT] AS kind, CASE WHEN l_suppkey % 5 = 0 THEN 2147483648 + l_suppkey ELSE l_suppkey % 1000 END AS level, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey + 10 END AS bottom FROM lineitem)"


@query(
    f"WITH {_LEVEL_SQL} SELECT DISTINCT kind, level, bottom, CASE kind WHEN 'surface' THEN '' WHEN 'potentialVorticity' THEN '_pv' || (CASE WHEN level >= 2147483648 THEN -(level - 2147483648) ELSE level END)::VARCHAR WHEN 'isobaricInhPa' THEN '_' || level || 'mb' WHEN 'heightAboveGround' THEN '_' || level || 'm' WHEN 'hybrid' THEN '_hyb' || level WHEN 'depthBelowLandLayer' THEN '_' || level || '-' || bottom || 'cm' WHEN 'sigmaLayer' THEN '_sig' || level || '-' || bottom WHEN 'tropopause' THEN '_trop' WHEN 'cloudBase' THEN '_cldbase' ELSE "
    f"'_' || {_SANE.format('kind')} || (CASE WHEN bottom <> 0 AND bottom <> level THEN '_' || level || '_' || bottom WHEN level <> 0 THEN '_' || level ELSE '' END) END AS suffix FROM lv"
)
def level_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix that a level gives a variable's name."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("l_partkey") % 10 + 1).cast("int"))
    lv = li.select(kind.alias("kind"), F.when(F.col("l_suppkey") % 5 == 0, F.lit(2147483648) + F.col("l_suppkey")).otherwise(F.col("l_suppkey") % 1000).alias("level"), F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey") + 10).alias("bottom")).distinct()
    return lv.withColumn("suffix", N.level_suffix(F.col("kind"), F.col("level"), F.col("bottom")))


_SHORT = ["t", "2t", "u", "msl", "tp", "xyz", "T ", "zdr"]
_UNITS = ["K", "m/s", "Pa", "banana"]


def _lookup(n: dict[str, float], what: str) -> str:
    return f"CASE {what} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in n.items()) + " END"


@query(
    "WITH v AS (SELECT s_suppkey, [" + ", ".join(f"'{x}'" for x in _SHORT) + "][(s_suppkey % 8 + 1)::INT] AS short, [" + ", ".join(f"'{x}'" for x in _UNITS) + "][(s_suppkey % 4 + 1)::INT] AS unit, 'var' || s_suppkey AS name, s_acctbal AS hi, CASE WHEN s_suppkey % 6 = 0 THEN s_acctbal ELSE s_acctbal - 100 END AS lo FROM supplier), "
    "p AS (SELECT *, CASE WHEN name = 'var13' THEN 0.7::DOUBLE WHEN name = 'var20' THEN 0.3::DOUBLE WHEN short = 'u' THEN 0.9::DOUBLE END AS o, coalesce(" + _lookup(N.PRECISION_BY_NAME, "lower(trim(short))") + ", " + _lookup(N.PRECISION_BY_UNIT, "trim(unit)") + ") AS a FROM v) "
    "SELECT s_suppkey, round(CASE WHEN o IS NOT NULL THEN o WHEN a IS NOT NULL THEN a WHEN hi > lo THEN (hi - lo) / 1024 ELSE 0 END, 9) AS step, CASE WHEN o IS NOT NULL THEN 'override' WHEN a IS NOT NULL THEN 'auto' WHEN hi > lo THEN 'cap' ELSE 'default' END AS source FROM p"
)
def variable_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of each variable by override, name, unit, range or none; and where it comes from."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("s_suppkey") % n + 1).cast("int"))
    v = table(spark, sf_dir, "supplier").select("s_suppkey", pick(_SHORT, 8).alias("short"), pick(_UNITS, 4).alias("unit"), F.concat(F.lit("var"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_acctbal").alias("hi"), F.when(F.col("s_suppkey") % 6 == 0, F.col("s_acctbal")).otherwise(F.col("s_acctbal") - 100).alias("lo"))
    step, source = N.resolved_precision(F.col("name"), F.col("short"), F.col("unit"), F.col("lo"), F.col("hi"), N.parse_overrides(F.lit("var13=0.7, var20=0.3,u=0.9")))
    return v.select("s_suppkey", F.round(step, 9).alias("step"), source.alias("source"))


@query("WITH s AS (SELECT s_nationkey, ['auto', 'cap', 'default', 'override'][(s_suppkey % 4 + 1)::INT] AS source FROM supplier) SELECT s_nationkey, CASE min(CASE source WHEN 'override' THEN 0 WHEN 'auto' THEN 1 WHEN 'cap' THEN 2 ELSE 3 END) WHEN 0 THEN 'override' WHEN 1 THEN 'auto' WHEN 2 THEN 'cap' ELSE 'default' END AS source FROM s GROUP BY s_nationkey")
def dominant_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a variable's blocks the source that wins."""
    order = ["override", "auto", "cap", "default"]
    s = table(spark, sf_dir, "supplier")
    src = F.element_at(F.array(*map(F.lit, ("auto", "cap", "default", "override"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rank = F.array_position(F.array(*map(F.lit, order)), src)
    return s.groupBy("s_nationkey").agg(F.element_at(F.array(*map(F.lit, order)), F.min(rank).cast("int")).alias("source"))


@query("SELECT l_returnflag, arg_min(tag, (-n) * 10 + tag)::INT AS codec FROM (SELECT l_returnflag, l_linenumber % 4 AS tag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def dominant_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the commonest codec of a block's chunks; the lower tag of equals."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_linenumber") % 4).alias("tag")).agg(F.count("*").alias("n"))
    return c.groupBy("l_returnflag").agg(F.max_by("tag", F.struct("n", -F.col("tag"))).cast("int").alias("codec"))


_UNIT_SECONDS = "CASE unit " + " ".join(f"WHEN {k} THEN {v}" for k, v in N.UNIT_SECONDS.items()) + " ELSE 0 END"


@query(f"WITH r AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS reference, (o_custkey % 15)::INT AS unit, o_orderkey % 30 AS step FROM orders) SELECT o_orderkey, unit, step * ({_UNIT_SECONDS}) AS seconds, reference + to_seconds(step * ({_UNIT_SECONDS}) % 1000000000) AS valid FROM r")
def grib_time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast steps in coded units as seconds, and the valid time."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("reference"), (F.col("o_custkey") % 15).cast("int").alias("unit"), (F.col("o_orderkey") % 30).alias("step"))
    s = r.withColumn("seconds", F.col("step") * N.unit_seconds(F.col("unit")))
    return s.select("o_orderkey", "unit", "seconds", (F.col("reference") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("seconds") % 1000000000).cast("decimal(18,6)"))).alias("valid"))


@query("WITH r AS (SELECT e.event_id, ['seconds', 'minutes', 'hours', 'days', 'fortnights'][(event_id % 5 + 1)::INT] AS unit, event_id % 1000 AS v FROM events e) SELECT event_id, CASE unit WHEN 'seconds' THEN 1 WHEN 'minutes' THEN 60 WHEN 'hours' THEN 3600 WHEN 'days' THEN 86400 END AS per, TIMESTAMP '2026-01-01 06:30:00' + to_seconds(v * CASE unit WHEN 'seconds' THEN 1 WHEN 'minutes' THEN 60 WHEN 'hours' THEN 3600 WHEN 'days' THEN 86400 END) AS valid FROM r")
def cf_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T08: "<unit> since <time>" as times; unknown units give none."""
    units = F.element_at(F.array(*(F.lit(f"{u} since 2026-01-01 06:30:00") for u in ("seconds", "minutes", "hours", "days", "fortnights"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", units.alias("units"), (F.col("event_id") % 1000).alias("v"))
    epoch, per = N.cf_epoch(F.col("units"))
    return e.select("event_id", per.alias("per"), (epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("v") * per).cast("decimal(18,6)"))).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE round((floor(value + 0.5) * 0.1::DOUBLE + 273.15::DOUBLE)::FLOAT::DOUBLE, 4) END AS value FROM events")
def cf_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed integers as values: fill is missing, the rest scaled and shifted."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, -9999).otherwise(F.floor(F.col("value") + 0.5).cast("int")).alias("raw"))
    return e.select("event_id", F.round(N.unpacked(F.col("raw"), -9999, 0.1, 273.15).cast("double"), 4).alias("value"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d, strptime(strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || '3015', '%Y%m%d%H%M%S') AS ts FROM orders")
def odim_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date and a time of digits as a timestamp."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("3015")).alias("t"))
    return o.select("o_orderkey", "d", F.to_timestamp(F.concat("d", "t"), "yyyyMMddHHmmss").cast("timestamp_ntz").alias("ts"))


@query("WITH r AS (SELECT p_partkey, [100, 103, 101, 106, 1, 105, 8, 77][(p_partkey % 8 + 1)::INT] AS t1, (p_size % 3)::INT AS sf, (p_partkey * 10)::BIGINT AS v FROM part), s AS (SELECT *, trunc(v * (CASE WHEN sf = 0 THEN 1.0::DOUBLE WHEN sf = 1 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END))::BIGINT AS x FROM r) SELECT p_partkey, CASE t1 WHEN 100 THEN 'isobaricInhPa' WHEN 103 THEN 'heightAboveGround' WHEN 101 THEN 'meanSea' WHEN 106 THEN 'depthBelowLand' WHEN 1 THEN 'surface' WHEN 105 THEN 'hybrid' WHEN 8 THEN 'nominalTop' ELSE 'level_' || t1 END AS kind, CASE WHEN t1 = 100 THEN x // 100 WHEN t1 IN (101, 1, 8) THEN 0 ELSE x END AS level FROM s")
def level_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface codes and scaled values as levels."""
    t1 = F.element_at(F.array(*map(F.lit, (100, 103, 101, 106, 1, 105, 8, 77))), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", t1.alias("t1"), (F.col("p_size") % 3).alias("sf"), (F.col("p_partkey") * 10).alias("v"))
    kind, level = N.decoded_level(F.col("t1"), F.col("sf"), F.col("v"))
    return p.select("p_partkey", kind.alias("kind"), level.alias("level"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0::DOUBLE) ELSE printf('%.1f MiB', b / 1048576.0::DOUBLE) END AS size_, format('{:,}', b) AS grouped FROM (SELECT *, floor(l_extendedprice * l_linenumber * l_quantity)::BIGINT AS b FROM lineitem)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and counts for people."""
    li = table(spark, sf_dir, "lineitem").withColumn("b", F.floor(F.col("l_extendedprice") * F.col("l_linenumber") * F.col("l_quantity")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.human_size(F.col("b")).alias("size_"), F.format_number("b", 0).alias("grouped"))


def name_hash(s: Column) -> Column:
    """The string's hash of factor 31, its low byte."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFF))


@query("WITH RECURSIVE h AS (SELECT p_partkey, p_name AS s, 1 AS i, 0::BIGINT AS h FROM part UNION ALL SELECT p_partkey, s, i + 1, (h * 31 + ascii(substr(s, i, 1))) & 4294967295 FROM h WHERE i <= length(s)) SELECT p_partkey, h & 255 AS code FROM h WHERE i = length(s) + 1")
def name_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte for each name."""
    return table(spark, sf_dir, "part").select("p_partkey", name_hash(F.col("p_name")).alias("code"))


@query("WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tmp' WHEN 1 THEN 'tmp_500mb' WHEN 2 THEN 'tmp_' || p_size || 'm' ELSE 'tmp_surface' END AS name FROM part), l AS (SELECT *, CASE WHEN strpos(name, '_') = 0 THEN NULL ELSE substr(name, strpos(name, '_') + 1) END AS level FROM n) SELECT p_partkey, split_part(name, '_', 1) AS param, level, CASE WHEN level IS NULL THEN 0 WHEN regexp_matches(level, '^[0-9]') THEN 1 ELSE 2 END AS rank_, TRY_CAST(regexp_extract(coalesce(level, ''), '^([0-9]+)', 1) AS BIGINT) AS num FROM l")
def level_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names split into parameter and level, with the levels' sort key: none, numbers, texts."""
    k = F.col("p_partkey") % 4
    n = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "tmp").when(k == 1, "tmp_500mb").when(k == 2, F.concat(F.lit("tmp_"), F.col("p_size").cast("string"), F.lit("m"))).otherwise("tmp_surface").alias("name"))
    level = F.when(F.instr("name", "_") > 0, F.expr("substring(name, instr(name, '_') + 1)"))
    out = n.withColumn("level", level)
    number = F.expr("try_cast(regexp_extract(level, '^([0-9]+)', 1) AS BIGINT)")
    return out.select("p_partkey", F.split_part("name", F.lit("_"), F.lit(1)).alias("param"), "level", F.when(F.col("level").isNull(), 0).when(F.rlike("level", F.lit("^[0-9]")), 1).otherwise(2).alias("rank_"), number.alias("num"))


@query("SELECT DISTINCT CASE WHEN regexp_matches(lower(f), '\\.(grib2?|grb2?)$') THEN 'grib' WHEN regexp_matches(lower(f), '\\.(h5|hdf5?|nc4?)$') THEN 'hdf5' ELSE 'unknown' END AS format, f AS path FROM (SELECT 'in/' || p_partkey % 40 || ['.grib2', '.GRB', '.h5', '.nc', '.txt'][(p_partkey % 5 + 1)::INT] AS f FROM part)")
def input_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct input paths with the format their names tell (contents decide first where files are read)."""
    ext = F.element_at(F.array(*map(F.lit, (".grib2", ".GRB", ".h5", ".nc", ".txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("in/"), (F.col("p_partkey") % 40).cast("string"), ext).alias("path")).distinct()
    return p.select(N.format_of(F.col("path")).alias("format"), "path")
