"""Codecs, versioned datasets and streams."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.operators import codecs, dataset
from isoweave.streaming import append


@pytest.mark.parametrize("dtype", ["<u1", "<u2"])
def test_codec_round_trip(dtype):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:64, 0:64]
    for data in (rng.integers(0, 250, 4096), (x + y + x * y // 16).reshape(-1) % 251, np.full(4096, 7)):
        d = data.astype(dtype)
        blob = codecs.encode(d, 64)
        assert (codecs.decode(blob, 4096, 64, np.dtype(dtype)) == d).all()
    assert codecs.encode(np.full(16, 3, dtype), 4)[0] == codecs.CONSTANT
    smooth = (1000 + x + y + x * y // 16).reshape(-1).astype("<u2")
    assert codecs.encode(smooth, 64)[0] == codecs.LORENZO


def test_codec_floats_and_errors():
    f = np.random.default_rng(2).normal(size=256).astype("<f4")
    assert (codecs.decode(codecs.encode(f, 16), 256, 16, np.dtype("<f4")) == f).all()
    for bad in (b"", b"\x09abc"):
        with pytest.raises(ValueError):
            codecs.decode(bad, 4, 2, np.dtype("<u1"))


def test_varints_and_checksum():
    for v in (0, 1, 127, 128, 300, 1 << 35, (1 << 64) - 1):
        assert codecs.read_varint(codecs.varint(v)) == (v, len(codecs.varint(v)))
    with pytest.raises(EOFError):
        codecs.read_varint(b"\x80")
    with pytest.raises(OverflowError):
        codecs.read_varint(b"\xff" * 11)
    assert codecs.crc32c(b"123456789") == 0xE3069283


def tiles(spark, rows):
    return spark.createDataFrame([(v, t, 1, x, 0, [float(x + i + base) for i in range(4)]) for v, t, x, base in rows], "variable int, time_id long, z int, x long, y long, pixels array<float>")


def test_dataset_states(spark, tmp_path):
    path = str(tmp_path / "d")
    dataset.write(tiles(spark, [(0, 0, 0, 0), (0, 1, 1, 0)]), path)
    made = dataset.append(tiles(spark, [(0, 1, 1, 100), (1, 1, 0, 5)]), path)
    assert made == {"submitted": 2, "present": 1, "late": 0, "generation": 1}
    assert dataset.append(tiles(spark, [(0, 2, 0, 7)]), path)["generation"] == 2
    assert {(r["variable"], r["time_id"]) for r in dataset.read(spark, path).collect()} == {(0, 0), (0, 1), (1, 1), (0, 2)}
    assert dataset.read(spark, path, 0).count() == 2
    dataset.append(tiles(spark, [(0, 1, 1, 100)]), path, replace=True)
    assert dataset.read(spark, path).filter("variable = 0 AND time_id = 1").first()["pixels"][0] == 101.0
    with pytest.raises(dataset.Late):
        dataset.append(tiles(spark, [(0, -1, 0, 0)]), path)
    assert dataset.append(tiles(spark, [(0, -1, 0, 0)]), path, late="drop")["late"] == 1
    dataset.compact(spark, path, str(tmp_path / "c"))
    key = lambda p: sorted((r["variable"], r["time_id"], r["x"], tuple(r["pixels"])) for r in dataset.read(spark, p).collect())
    assert key(path) == key(str(tmp_path / "c")) and dataset.generations(spark, str(tmp_path / "c")) == [0]


def test_fallback_to_previous(spark, tmp_path):
    path = str(tmp_path / "d")
    dataset.write(tiles(spark, [(0, 0, 0, 0)]), path)
    dataset.append(tiles(spark, [(1, 1, 0, 0)]), path)
    assert dataset.active(spark, path) == 1
    shutil.rmtree(tmp_path / "d" / "blocks" / "gen=1")  # a torn generation
    assert dataset.active(spark, path) == 0 and dataset.read(spark, path).count() == 1
    with pytest.raises(FileNotFoundError):
        dataset.active(spark, str(tmp_path / "none"))


def test_stream_appends(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "d")
    for k in range(3):
        tiles(spark, [(0, k, 0, k), (1, k, 0, k)]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(tiles(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = append.append_stream(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert dataset.read(spark, path).filter("time_id = 2").count() == 2


def test_stream_windows(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = append.hourly(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    name = f"w{random.randrange(10**9)}"
    q = s.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table(name).select("start_", "event_type", "n").collect()}
    assert got == {tuple(r) for r in append.hourly(e).select("start_", "event_type", "n").collect()}
