"""Arrays, GRIB2 messages, names and times."""

import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.functions import names as N
from isoweave.plans.points import sampled
from isoweave.sources import arrays, grib


def message(values: np.ndarray, width: int = 12, missing: int | None = None) -> bytes:
    """A message of nx 4, ny 3, reference 250, binary scale 0, decimal scale 1."""
    present = np.ones(12, bool)
    if missing is not None:
        present[missing] = False
    codes = values[present]
    bits = np.array([[int(c) >> (width - 1 - k) & 1 for k in range(width)] for c in codes], np.uint8).reshape(-1)
    body = np.packbits(bits).tobytes()
    sec = lambda n, b: struct.pack(">IB", len(b) + 5, n) + b
    s1 = sec(1, struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, 2026, 5, 3, 6, 0, 0, 0, 1))
    grid = struct.pack(">BIBBH", 0, 12, 0, 0, 0) + b"\x06" + bytes(15) + struct.pack(">IIII", 4, 3, 0, 0) + struct.pack(">IIBIIIIB", 50_000_000, 10_000_000, 48, 52_000_000, 13_000_000, 1_000_000, 1_000_000, 64)
    s3 = sec(3, grid)
    s4 = sec(4, struct.pack(">HHBBBBBHBBIBBIBBI", 0, 0, 0, 0, 2, 0, 0, 0, 0, 1, 6, 103, 0, 2, 255, 0, 0))
    s5 = sec(5, struct.pack(">IHfHHBB", int(present.sum()), 0, 250.0, 0, 1, width, 0))
    s6 = sec(6, b"\xff" if missing is None else b"\x00" + np.packbits(present).tobytes())
    rest = s1 + s3 + s4 + s5 + s6 + sec(7, body) + b"7777"
    return b"GRIB" + bytes([0, 0, 0, 2]) + struct.pack(">Q", 16 + len(rest)) + rest


def test_grib(spark, tmp_path):
    x = np.arange(12) * 3
    (tmp_path / "a.grib2").write_bytes(b"junk" + message(x) + message(x, 16, missing=5) + b"GRIBtail")
    found = grib.messages(spark, str(tmp_path))
    assert found.count() == 2
    a, b = grib.records(found).orderBy("at").collect()
    assert a["problem"] is None and (a["nx"], a["ny"], a["lat1"], a["lon2"], a["dx"], a["level_type"], a["level"]) == (4, 3, 50.0, 13.0, 1.0, 103, 2.0)
    assert (a["category"], a["parameter"], a["unit"], a["forecast"]) == (0, 0, 1, 6)
    assert a["reference_time"] == datetime(2026, 5, 3, 6)
    assert np.allclose(a["values"], (250 + x) / 10)
    assert b["values"][5] is None and np.allclose(b["values"][6], (250 + x[6]) / 10)
    assert grib.records(found, headers_only=True).filter("values IS NULL").count() == 2


def test_broken_grib(spark):
    m = message(np.arange(12))
    found = spark.createDataFrame([("x", 0, m[:60]), ("y", 0, b"GRIB")], grib.MESSAGE)
    assert all(r["problem"].startswith("broken") for r in grib.records(found).collect())


def test_arrays(spark):
    t = datetime(2026, 5, 13, 12)
    field = [(30 + 0.5 * j) + (0.5 * i) / 1000 for j in range(33) for i in range(64)]
    a = arrays.add_arrays(spark, [("v", "K", t, 64, 33, 30.0, 0.0, 0.5, 0.5, None, field)])
    assert tuple(arrays.bounds(a).first()) == (0.0, 30.0, 31.5, 46.0)
    g = {"nx": 64, "ny": 33, "lat0": 30.0, "lon0": 0.0, "dy": 0.5, "dx": 0.5}
    cells = arrays.cells(a).select("variable", F.lit(0).alias("time_id"), "gy", "gx", "value")
    pts = spark.createDataFrame([(1, 30.0, 0.0), (2, 32.5, 2.5), (3, 90.0, 0.0), (4, 31.25, 1.25)], "point long, lat double, lon double")
    got = {r["point"]: r["value"] for r in sampled(pts, cells, g).collect()}
    assert set(got) == {1, 2, 4} and abs(got[2] - 32.5025) < 1e-4 and abs(got[4] - 31.25125) < 1e-4


def test_missing_neighbour(spark):
    t = datetime(2026, 1, 1)
    data = [-9999.0 if x < 4 or y < 4 else float(x + y) for y in range(32) for x in range(32)]
    a = arrays.add_arrays(spark, [("v", "", t, 32, 32, 0.0, 0.0, 1.0, 1.0, -9999.0, data)])
    g = {"nx": 32, "ny": 32, "lat0": 0.0, "lon0": 0.0, "dy": 1.0, "dx": 1.0}
    cells = arrays.cells(a).select("variable", F.lit(0).alias("time_id"), "gy", "gx", "value")
    pts = spark.createDataFrame([(1, 1.5, 1.5), (2, 10.0, 10.0), (3, 3.5, 3.5)], "point long, lat double, lon double")
    assert {r["point"]: r["value"] for r in sampled(pts, cells, g).collect()} == {1: None, 2: 20.0, 3: None}


def test_turned_array(spark):
    a = arrays.add_arrays(spark, [("v", "", datetime(2026, 1, 1), 2, 2, 1.0, 0.0, -1.0, 1.0, None, [1, 2, 3, 4])])
    assert [r["value"] for r in arrays.cells(a).orderBy("gy", "gx").collect()] == [3, 4, 1, 2]


def test_bad_arrays(spark):
    with pytest.raises(ValueError):
        arrays.add_arrays(spark, [("v", "", datetime(2026, 1, 1), 1, 2, 0, 0, 1, 1, None, [1, 2])])


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(N.sanitized(F.lit("  My  Höhe-7 "))) == "my_h_he_7"
    assert one(N.level_suffix(F.lit("isobaricInhPa"), F.lit(500), F.lit(0))) == "_500mb"
    assert one(N.level_suffix(F.lit("depthBelowLandLayer"), F.lit(0), F.lit(10))) == "_0-10cm"
    assert one(N.level_suffix(F.lit("potentialVorticity"), F.lit(2147483650), F.lit(0))) == "_pv-2"
    assert one(N.sniffed(F.lit(b"GRIB...."), F.lit("x.nc"))) == "grib" and one(N.sniffed(F.lit(b"...."), F.lit("x.nc"))) == "hdf5"
