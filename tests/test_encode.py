"""Source arrays to tiles and datasets: linear fields come back exactly, missing cells and edges stay missing."""

import math
from datetime import datetime

import pytest

from isoweave.operators import dataset, encode
from isoweave.sources.arrays import add_arrays


def place(z, x, y, k, size):
    lon = (x + (k % size + 0.5) / size) / 2**z * 360 - 180
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + (k // size + 0.5) / size) / 2**z)))), lon


@pytest.mark.parametrize("south_first", [True, False])
def test_linear_field(spark, tmp_path, south_first):
    ny, nx, step = 33, 64, 0.5
    lats = [30 + step * j for j in range(ny)]
    rows = lats if south_first else lats[::-1]
    data = [lat + (step * i) / 1000 for lat in rows for i in range(nx)]
    one = lambda ts, add: ("v", "K", ts, nx, ny, rows[0], 0.0, step if south_first else -step, step, None, [v + add for v in data])
    arrays = add_arrays(spark, [one(datetime(2026, 5, 13, 12), 0), one(datetime(2026, 5, 13, 13), 1)])
    encode.encode(arrays, str(tmp_path / "d"), range(2, 5))
    got = dataset.read(spark, str(tmp_path / "d")).collect()
    assert {r["time_id"] for r in got} == {0, 1} and {r["z"] for r in got} == {2, 3, 4}
    seen = 0
    for r in got:
        for k, v in enumerate(r["pixels"]):
            lat, lon = place(r["z"], r["x"], r["y"], k, 8)
            inside = 30 <= lat <= 46 and 0 <= lon <= 31.5
            assert (v is not None) == inside
            if inside:
                seen += 1
                assert abs(v - (lat + lon / 1000 + r["time_id"])) < 1e-4
    assert seen > 100


def test_missing_cells(spark):
    nx = ny = 32
    data = [-9999.0 if x < 4 or y < 4 else float(x + y) for y in range(ny) for x in range(nx)]
    arrays = add_arrays(spark, [("v", "1", datetime(2026, 1, 1), nx, ny, 0.0, 0.0, 1.0, 1.0, -9999.0, data), ("none", "1", datetime(2026, 1, 1), nx, ny, 0.0, 0.0, 1.0, 1.0, -9999.0, [-9999.0] * (nx * ny))])
    got = encode.tiles_of(arrays, range(4, 6)).collect()
    assert {r["variable"] for r in got} == {"v"}  # tiles without a value aren't there
    for r in got:
        for k, v in enumerate(r["pixels"]):
            lat, lon = place(r["z"], r["x"], r["y"], k, 8)
            known = 4 <= lat <= 31 and 4 <= lon <= 31
            assert (v is not None) == known and (not known or abs(v - lat - lon) < 1e-4)
