"""Angles and their circular mean."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def normalize(angle: Column, n: float = 2 * PI) -> Column:
    """Into [0, n)."""
    r = angle % F.lit(n)
    return F.when(r < 0, r + F.lit(n)).otherwise(r)


def difference(a: Column, b: Column, n: float = 2 * PI) -> Column:
    """Absolute difference on the circle, n/2 at most."""
    d = F.abs(normalize(a, n) - normalize(b, n))
    return F.when(d > n / 2, F.lit(n) - d).otherwise(d)


def deg_to_rad(c: Column) -> Column:
    return c * F.lit(PI) / F.lit(180.0)


def rad_to_deg(c: Column) -> Column:
    return c * F.lit(180.0) / F.lit(PI)


def circular_mean(radians: Column, tolerance: float) -> Column:
    """Aggregate: mean direction; NaN where the directions cancel out, 0 where it is below the tolerance."""
    x, y = F.sum(F.cos(radians)), F.sum(F.sin(radians))
    mean = F.atan2(y, x)
    return F.when((F.abs(x) < tolerance) & (F.abs(y) < tolerance), F.lit(float("nan"))).when(F.abs(mean) < tolerance, 0.0).otherwise(mean)
