"""Parameters and codes of the quantiser."""

from pyspark.sql import functions as F

from isoweave.functions import quantize as Q


def fitted(spark, lo, hi, p):
    d, s, o = Q.fit(F.lit(lo), F.lit(hi), F.lit(p))
    return tuple(spark.range(1).select(d.alias("d"), s.alias("s"), o.alias("o")).first())


def test_parameters(spark):
    assert fitted(spark, 0.0, 100.0, 1.0)[0] == Q.U8
    assert fitted(spark, 0.0, 1000.0, 0.1)[0] == Q.U16
    assert fitted(spark, 0.0, 1.0, 1e-7)[0] == Q.F32
    assert fitted(spark, 42.0, 42.0, 0.0) == (Q.U16, 0.0, 42.0)
    assert fitted(spark, 5.0, 1.0, 0.1)[0] == Q.F32


def test_round_trip_bound(spark):
    v = spark.range(1024).select((200 + F.col("id") * 0.1267).cast("float").alias("v"))
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    d, s, o = (F.lit(x) for x in fitted(spark, float(lo), float(hi), 0.0))
    out = v.withColumn("q", Q.quantized(F.col("v"), d, s, o)).withColumn("b", Q.dequantized(F.col("q"), F.col("v"), d, s, o))
    worst, tol = out.agg(F.max(F.abs(F.col("b") - F.col("v"))), F.max(Q.tolerance(s, F.lit(float(lo)), F.lit(float(hi))))).first()
    assert worst <= tol


def test_missing(spark):
    v = spark.createDataFrame([(float("nan"),), (9999.0,), (None,), (1.0,)], "v double").select(Q.present(F.col("v"), 9999.0).alias("v"))
    assert [r["v"] for r in v.collect()] == [None, None, None, 1.0]
