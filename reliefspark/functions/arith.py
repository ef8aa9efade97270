"""The rounding and remainder rules that decide whether results are equal to the bit, each in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_int(c: Column) -> Column:
    """Towards zero."""
    return c.cast("int")


def round_half_even(c: Column) -> Column:
    return F.rint(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio_to_byte_trunc(c: Column) -> Column:
    """0..1 to 0..255, truncated: the rule of shaders."""
    return clamp(trunc_int(c * 255.0), 0, 255)


def ratio_to_byte_round(c: Column) -> Column:
    """0..1 to 0..255, half to even: the rule of compositing."""
    return clamp(round_half_even(c * 255.0).cast("int"), 0, 255)


def tolerant_compare(a: Column, b: Column, tolerance: float) -> Column:
    """0 within the tolerance, else -1 or 1."""
    return F.when(F.abs(a - b) <= tolerance, 0).when(a < b, -1).otherwise(1)


def value_01_status(v: Column, tolerance: float) -> Column:
    """Where a value lies against the segment 0..1."""
    near0, near1 = F.abs(v) <= tolerance, F.abs(v - 1) <= tolerance
    return F.when(near0, "zero").when(near1, "one").when(v < 0, "below").when(v > 1, "above").otherwise("between")
