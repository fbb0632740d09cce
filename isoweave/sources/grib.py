"""GRIB2 messages with simple packing on regular latitude/longitude grids (WMO FM 92).

`messages` splits files into rows of one message; `records` decodes each into a row with its header and values.
Sections 0, 1, 3 (template 3.0), 4 (4.0, 4.1, 4.8), 5 (5.0), 6 and 7 are read; other messages come out with a null
`values` and the reason in `problem`, so that none is lost silently. Decoding is numpy within Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "path string, at long, message binary"
RECORD = (
    "path string, at long, discipline int, category int, parameter int, level_type int, level double, reference_time timestamp_ntz, unit int, forecast int, "
    "nx int, ny int, lat1 double, lon1 double, lat2 double, lon2 double, dx double, dy double, scan_mode int, values array<float>, problem string"
)


def unpacked(x: Column, reference: Column, binary: Column, decimal: Column) -> Column:
    """Simple packing as an expression: (R + x 2^E) 10^-D."""
    return (reference + 0 * x) * F.pow(F.lit(10.0), -decimal) + x * F.pow(F.lit(2.0), binary) * F.pow(F.lit(10.0), -decimal)


def split(data: bytes) -> list[tuple[int, bytes]]:
    """Offset and bytes of each message; what isn't a whole edition 2 message is skipped."""
    out, at = [], data.find(b"GRIB")
    while at >= 0:
        n = struct.unpack(">Q", data[at + 8 : at + 16])[0] if len(data) >= at + 16 else 0
        if n >= 20 and data[at + 7] == 2 and at + n <= len(data) and data[at + n - 4 : at + n] == b"7777":
            out.append((at, data[at : at + n]))
            at = data.find(b"GRIB", at + n)
        else:
            at = data.find(b"GRIB", at + 4)
    return out


def signed(raw: int, bits: int) -> int:
    """Sign and magnitude."""
    top = 1 << (bits - 1)
    return -(raw & (top - 1)) if raw & top else raw


def bits_of(data: bytes, width: int, n: int) -> np.ndarray:
    """n unsigned numbers of `width` bits, most significant bit first."""
    if width == 0:
        return np.zeros(n)
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype(np.float64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=width * n).reshape(n, width)
    return bits @ (2.0 ** np.arange(width - 1, -1, -1))


def decode(message: bytes) -> dict:
    """Header fields and values of a message."""
    out: dict = {"discipline": message[6]}
    at, packing, present = 16, None, None
    while message[at : at + 4] != b"7777":
        n, number = struct.unpack(">IB", message[at : at + 5])
        s = message[at : at + n]
        if number == 1:
            y, mo, d, h, mi, se = struct.unpack(">HBBBBB", s[12:19])
            out["reference_time"] = np.datetime64(f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{se:02d}").astype("datetime64[us]").item()
        elif number == 3:
            if struct.unpack(">H", s[12:14])[0] != 0:
                return out | {"problem": "grid template"}
            nx, ny = struct.unpack(">II", s[30:38])
            angle = lambda k: signed(struct.unpack(">I", s[k : k + 4])[0], 32) / 1e6
            out |= {"nx": nx, "ny": ny, "lat1": angle(46), "lon1": angle(50), "lat2": angle(55), "lon2": angle(59), "dx": angle(63), "dy": angle(67), "scan_mode": s[71]}
        elif number == 4:
            if struct.unpack(">H", s[7:9])[0] not in (0, 1, 8):
                return out | {"problem": "product template"}
            factor, value = signed(s[23], 8), signed(struct.unpack(">I", s[24:28])[0], 32)
            out |= {"category": s[9], "parameter": s[10], "unit": s[17], "forecast": signed(struct.unpack(">I", s[18:22])[0], 32), "level_type": s[22], "level": value * 10.0**-factor}
        elif number == 5:
            count, template = struct.unpack(">IH", s[5:11])
            if template != 0:
                return out | {"problem": "packing template"}
            r, e, d, width = struct.unpack(">fHHB", s[11:20])
            packing = (count, r, signed(e, 16), signed(d, 16), width)
        elif number == 6:
            if s[5] == 0:
                present = np.unpackbits(np.frombuffer(s[6:], np.uint8), count=out["nx"] * out["ny"]).astype(bool)
            elif s[5] != 255:
                return out | {"problem": "bitmap"}
        elif number == 7:
            count, r, e, d, width = packing
            values = ((r + bits_of(s[5:], width, count) * 2.0**e) * 10.0**-d).astype(np.float32)
            if present is not None:
                full = np.full(len(present), np.nan, np.float32)
                full[present] = values
                values = full
            out["values"] = values
        at += n
    return out


def messages(spark: SparkSession, path: str) -> DataFrame:
    """One row a message of all files below a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                got = split(data)
                yield pa.RecordBatch.from_arrays([pa.array([path_] * len(got), pa.string()), pa.array([a for a, _ in got], pa.int64()), pa.array([m for _, m in got], pa.binary())], names=["path", "at", "message"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MESSAGE)


def records(found: DataFrame, headers_only: bool = False) -> DataFrame:
    """A row of RECORD for each message; missing values are null. Without values if only headers are wanted."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, at, message in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "message"))):
                try:
                    r = decode(message)
                except (struct.error, KeyError, IndexError, ValueError, TypeError) as e:
                    r = {"problem": f"broken: {type(e).__name__}"}
                v = r.get("values")
                r["values"] = None if v is None or headers_only else [None if np.isnan(x) else float(x) for x in v]
                rows.append({"path": path, "at": at} | r)
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)

    return found.mapInArrow(run, RECORD)
