"""Scalar column functions shared by the operators. All arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bytes per voxel type; an unknown type counts as one byte.
BYTES_PER_VOXEL = {
    "uint8": 1, "int8": 1, "uint16": 2, "int16": 2,
    "uint32": 4, "int32": 4, "float32": 4, "float64": 8,
}
# The grey weights of ITU-R BT.601.
GRAY_WEIGHTS = (0.299, 0.587, 0.114)
# Per-channel mean and deviation of the encoder input.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def dbl(value) -> Column:
    """A double literal or cast; decimal literals would truncate quotients."""
    if isinstance(value, Column):
        return value.cast("double")
    if isinstance(value, str):
        return F.col(value).cast("double")
    return F.lit(float(value))


def round_half_up(c: Column) -> Column:
    """Rounds .5 towards plus infinity, unlike SQL ``round``."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, c))


def window_level(v: Column, lo, hi) -> Column:
    """Maps an intensity to 0..1 within a display window."""
    lo, hi = dbl(lo), dbl(hi)
    return clamp((v - lo) / F.greatest(hi - lo, F.lit(0.001)), 0.0, 1.0)


def gamma(t: Column, g) -> Column:
    return F.pow(t, dbl(g))


def bytes_per_voxel(data_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in BYTES_PER_VOXEL.items() for x in kv])
    return F.coalesce(known[F.lower(data_type)], F.lit(1))


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = GRAY_WEIGHTS
    return r * F.lit(wr) + g * F.lit(wg) + b * F.lit(wb)


def auto_tolerance(lo: Column, hi: Column) -> Column:
    """Region-growing tolerance suggested by an intensity range."""
    span = F.abs(hi - lo)
    wanted = F.greatest(F.lit(1e-6), span * F.lit(1e-4), span * F.lit(0.05))
    return F.when(span > 0, F.least(F.lit(64.0), wanted)).otherwise(F.lit(0.0))


def encoder_channel(v: Column, lo: Column, hi: Column, channel: int) -> Column:
    """One normalised encoder channel: window, clamp to 0..1, standardise."""
    t = clamp((v - lo) / F.greatest(F.lit(1e-6), hi - lo), 0.0, 1.0)
    return (t - F.lit(CHANNEL_MEAN[channel])) / F.lit(CHANNEL_STD[channel])


def to_class_id(c: Column, max_class: int | Column = 255) -> Column:
    """Rounds to a class id and clamps it to the mask's range; non-finite values become 0."""
    finite = c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.when(finite, clamp(round_half_up(c.cast("double")), 0, max_class)).otherwise(0).cast("int")


def number_or_null(c: str) -> Column:
    """The value, null for NaN, which Spark would order above every number."""
    return F.when(~F.isnan(dbl(c)), F.col(c))
