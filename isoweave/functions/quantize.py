"""Quantisation of blocks as column expressions: parameters from a range, codes in single precision, and back.

Missing values are null throughout; sentinels and NaN become null on the way in (`present`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the physical types and the largest code of a value; the one above stands for a missing value.
U8, U16, F32 = 0, 1, 3
EPS32 = 1.1920929e-7


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def present(v: Column, sentinel: float | None = None) -> Column:
    v = F.nanvl(v, F.lit(None).cast("double"))
    return v if sentinel is None else F.nullif(v, F.lit(sentinel).cast("double"))


def fit(lo: Column, hi: Column, precision: Column) -> tuple[Column, Column, Column]:
    """(dtype, scale, offset) of a block with values lo..hi; no valid range or too fine a step is kept as float."""
    codes = F.ceil((hi - lo) / precision) + 1
    flat, coarse = lo == hi, precision > 0
    u8, u16 = coarse & (codes <= 255), coarse & (codes <= 65535)
    bad = ~F.coalesce(lo <= hi, F.lit(False))
    dtype = F.when(bad, F32).when(flat, U16).when(u8, U8).when(u16, U16).when(coarse, F32).otherwise(U16)
    scale = F.when(bad, 1.0).when(flat, 0.0).when(u16, precision).when(coarse, 1.0).otherwise((hi - lo) / 65534.0)
    offset = F.when(bad, 0.0).when(flat | u16 | ~coarse, lo).otherwise(0.0)
    return dtype, scale, offset


def quantized(v: Column, dtype: Column, scale: Column, offset: Column) -> Column:
    """The code of a value, null for a missing value and for blocks kept as float."""
    top = F.when(dtype == U8, f32(254.0)).otherwise(f32(65534.0))
    r = (v.cast("float") - offset.cast("float")) * (F.lit(1.0) / scale).cast("float")
    code = F.when(r <= f32(0.0), F.lit(0)).when(r >= top, top.cast("int")).otherwise(F.floor(r + f32(0.5)).cast("int"))
    return F.when(v.isNull() | (dtype == F32), F.lit(None).cast("int")).when(scale == 0, F.lit(0)).otherwise(code)


def dequantized(code: Column, v: Column, dtype: Column, scale: Column, offset: Column) -> Column:
    return F.when(dtype == F32, v.cast("float")).otherwise((code.cast("double") * scale + offset).cast("float"))


def tolerance(scale: Column, lo: Column, hi: Column) -> Column:
    """The largest error that quantisation and single precision explain."""
    edge = F.greatest(F.abs(lo), F.abs(hi))
    return F.abs(scale) / 2 + 2 * F.when(edge == 0, 1.0).otherwise(edge) * EPS32
