"""Tile codecs in Arrow batches: constant, raw, bit-shuffled, delta and Lorenzo codes under zstandard.

A blob's first byte names its codec. `encode` takes the smallest of those that can hold a tile, `decode` gives the
codes back. Both are row by row within a batch; no shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Codec ids.
CONSTANT, RAW, BITSHUFFLE, DELTA, LORENZO = 1, 2, 3, 4, 5
WIDTHS = {0: np.dtype("<u1"), 1: np.dtype("<u2"), 3: np.dtype("<f4")}


def bitshuffle(x: np.ndarray) -> bytes:
    """Bit planes one after the other, the most significant first."""
    raw = x.astype(x.dtype.newbyteorder(">")).tobytes() if x.dtype.itemsize > 1 else x.tobytes()
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(x), 8 * x.dtype.itemsize)
    return np.packbits(bits.T).tobytes()


def unshuffle(data: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * 8 * dtype.itemsize).reshape(8 * dtype.itemsize, n)
    return np.frombuffer(np.packbits(bits.T).tobytes(), dtype.newbyteorder(">")).astype(dtype)


def lorenzo(x: np.ndarray, side: int) -> np.ndarray:
    q = x.reshape(-1, side)
    out = q.copy()
    out[:, 1:] -= q[:, :-1]
    out[1:] -= q[:-1]
    out[1:, 1:] += q[:-1, :-1]
    return out.reshape(-1)


def unlorenzo(r: np.ndarray, side: int) -> np.ndarray:
    return np.cumsum(np.cumsum(r.reshape(-1, side), axis=0, dtype=r.dtype), axis=1, dtype=r.dtype).reshape(-1)


def encode(x: np.ndarray, side: int, level: int = 3) -> bytes:
    """The smallest blob; floats take no predictor, as their differences don't come back exactly."""
    if len(x) and (x == x[0]).all():
        return bytes([CONSTANT]) + x[:1].tobytes()
    pack = zstandard.ZstdCompressor(level=level).compress
    options = [bytes([RAW]) + pack(x.tobytes()), bytes([BITSHUFFLE]) + pack(bitshuffle(x))]
    if x.dtype.kind == "u":
        delta = x.reshape(-1, side).copy()
        delta[1:] -= x.reshape(-1, side)[:-1]
        options += [bytes([DELTA]) + pack(bitshuffle(delta.reshape(-1))), bytes([LORENZO]) + pack(bitshuffle(lorenzo(x, side)))]
    return min(options, key=len)


def decode(blob: bytes, n: int, side: int, dtype: np.dtype) -> np.ndarray:
    if not blob:
        raise ValueError("an empty blob")
    kind, body = blob[0], blob[1:]
    if kind == CONSTANT:
        return np.full(n, np.frombuffer(body, dtype)[0], dtype)
    if kind not in (RAW, BITSHUFFLE, DELTA, LORENZO):
        raise ValueError(f"unknown codec {kind}")
    raw = zstandard.ZstdDecompressor().decompress(body)
    x = np.frombuffer(raw, dtype) if kind == RAW else unshuffle(raw, n, dtype)
    if len(x) != n:
        raise ValueError("a blob of another size")
    if kind == DELTA:
        return np.cumsum(x.reshape(-1, side), axis=0, dtype=dtype).reshape(-1)
    return unlorenzo(x, side) if kind == LORENZO else x


def varint(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    return bytes(out + bytes([v]))


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number and the place after it."""
    v = shift = 0
    for i in range(at, min(at + 10, len(data))):
        v |= (data[i] & 0x7F) << shift
        if data[i] < 0x80:
            if v >> 64:
                raise OverflowError("over 64 bits")
            return v, i + 1
        shift += 7
    raise OverflowError("over 10 bytes") if len(data) - at >= 10 else EOFError("cut off")


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_CRC = _crc_table()


def crc32c_all(blobs: list[bytes]) -> np.ndarray:
    """Castagnoli's checksum of each blob; a step takes the next byte of all that are as long."""
    n = np.array([len(b) for b in blobs], np.int64)
    order = np.argsort(-n, kind="stable")
    data = np.frombuffer(b"".join(blobs), np.uint8)
    at = (np.cumsum(n) - n)[order]
    c, table_ = np.full(len(blobs), 0xFFFFFFFF, np.uint32), np.array(_CRC, np.uint32)
    active = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")
    for i, k in enumerate(active.tolist()):
        c[:k] = table_[(c[:k] ^ data[at[:k] + i]) & 0xFF] ^ (c[:k] >> np.uint32(8))
    out = np.empty(len(blobs), np.int64)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    return int(crc32c_all([data])[0])


BLOBS = "dtype int, side int, codec int, blob binary, size int, crc long, exact boolean, total long"


def encoded(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with keys, dtype and codes (array<int>, null for missing): the blob, its codec, size and CRC32C, whether it decodes to the same codes, and their sum as decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, codes in zip(batch.column("dtype").to_pylist(), batch.column("codes").to_pylist()):
                dtype = WIDTHS[kind]
                x = np.array([(1 << 8 * dtype.itemsize) - 1 if c is None else c for c in codes]).astype(dtype)
                side = int(round(len(x) ** 0.5))
                blob = encode(x, side)
                back = decode(blob, len(x), side, dtype)
                out.append((kind, side, blob[0], blob, len(blob), None, bool((back == x).all()), int(back.astype(np.int64).sum())))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            cols[5] = pa.array(crc32c_all([r[3] for r in out]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], names=[*keys, "dtype", "side", "codec", "blob", "size", "crc", "exact", "total"])

    kinds = ", ".join(f"{k} {dict(tiles.dtypes)[k]}" for k in keys)
    return tiles.select(*keys, "dtype", "codes").mapInArrow(run, f"{kinds}, {BLOBS}")


def train_dictionary(samples: list[bytes], size: int = 4096) -> bytes | None:
    """A zstandard dictionary for small blobs, kept only if it saves more than 1.125 times its own size on the samples."""
    try:
        d = zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None
    plain = sum(len(zstandard.ZstdCompressor().compress(s)) for s in samples)
    less = sum(len(zstandard.ZstdCompressor(dict_data=d).compress(s)) for s in samples)
    return d.as_bytes() if plain - less > 1.125 * len(d.as_bytes()) else None


def pack_float(values: np.ndarray) -> bytes:
    """Floats with every NaN as the canonical one."""
    x = values.astype("<f4")
    x[np.isnan(x)] = struct.unpack("<f", b"\x00\x00\xc0\x7f")[0]
    return x.tobytes()
