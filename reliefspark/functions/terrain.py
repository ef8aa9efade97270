"""Interpolation, terrain derivatives and pixel shaders."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import color
from .angles import difference, normalize, rad_to_deg
from .arith import ratio_to_byte_trunc

# The default elevation scale, height and colour of each mark.
DEFAULT_SCALE = ((0, color.literal(204, 243, 255)), (1, color.literal(142, 212, 142)), (700, color.literal(245, 250, 196)), (1500, color.literal(217, 215, 189)), (2500, color.literal(242, 235, 210)), (3500, color.literal(255, 255, 255)))
SUN_AZIMUTH, SUN_ALTITUDE = -math.pi / 4, math.pi / 4


def bilinear(h1: Column, h2: Column, h3: Column, h4: Column, dx: Column, dy: Column) -> Column:
    """Null if any of the four is."""
    low = (h2 - h1) * dx + h1
    high = (h4 - h3) * dx + h3
    return (high - low) * dy + low


def horn(h: Sequence[Column], width: Column, height: Column) -> tuple[Column, Column]:
    """Gradient of a 3x3 neighbourhood, index 0 at (x-1, y-1), 8 at (x+1, y+1); null if any is."""
    p = ((h[8] + 2.0 * h[5] + h[2]) - (h[6] + 2.0 * h[3] + h[0])) / (8.0 * width)
    q = ((h[8] + 2.0 * h[7] + h[6]) - (h[2] + 2.0 * h[1] + h[0])) / (8.0 * height)
    return p, q


def slope_aspect(p: Column, q: Column) -> tuple[Column, Column]:
    return F.atan(F.sqrt(p * p + q * q)), normalize(F.lit(math.pi * 3 / 2) - F.atan2(q, p))


def igor(slope: Column, aspect: Column, azimuth: float = SUN_AZIMUTH, rgb: int = 0, intensity: float = 1.0) -> Column:
    darkness = slope / (math.pi / 2) * (difference(aspect, F.lit(azimuth)) / math.pi) * intensity
    return F.coalesce(color.with_alpha(F.lit(rgb).cast("long"), ratio_to_byte_trunc(darkness)), F.lit(0).cast("long"))


def lambert(slope: Column, aspect: Column, azimuth: float = SUN_AZIMUTH, altitude: float = SUN_ALTITUDE, rgb: int = 0, intensity: float = 1.0) -> Column:
    light = F.lit(math.sin(altitude)) * F.cos(slope) + F.lit(math.cos(altitude)) * F.sin(slope) * F.cos(aspect - azimuth)
    darkness = (1.0 - F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0))) * intensity
    darkness = F.when(slope.isNotNull() & aspect.isNotNull(), darkness)
    return F.coalesce(color.with_alpha(F.lit(rgb).cast("long"), ratio_to_byte_trunc(darkness)), F.lit(0).cast("long"))


def slope_color(slope: Column, horizontal: int = 0, vertical: int = 255, intensity: float = 1.0) -> Column:
    mixed = color.mix(F.lit(horizontal).cast("long"), F.lit(vertical).cast("long"), rad_to_deg(slope) / 90.0 * intensity)
    return F.when(slope.isNotNull(), mixed).otherwise(F.lit(0).cast("long"))


# North red, east green, south blue, west cyan.
COMPASS = (color.literal(255, 0, 0), color.literal(0, 255, 0), color.literal(0, 0, 255), color.literal(0, 255, 255))


def aspect_color(aspect: Column, compass: Sequence[int] = COMPASS) -> Column:
    deg = normalize(rad_to_deg(aspect), 360.0)
    n, e, s, w = (F.lit(c).cast("long") for c in compass)
    part = [color.mix(a, b, (deg - at) / 90.0) for a, b, at in ((n, e, 0.0), (e, s, 90.0), (s, w, 180.0), (w, n, 270.0))]
    return F.when(aspect.isNull(), F.lit(0).cast("long")).when(deg <= 90, part[0]).when(deg <= 180, part[1]).when(deg <= 270, part[2]).otherwise(part[3])


def elevation_color(height: Column, scale: Sequence[tuple[int, int]] = DEFAULT_SCALE, none: int = 0) -> Column:
    """As-of lookup between marks, linear in between; the scale is a plan constant, so it folds into one CASE."""
    out = F.when(height.isNull(), F.lit(none).cast("long")).when(height <= scale[0][0], F.lit(scale[0][1]).cast("long"))
    for (h0, c0), (h1, c1) in zip(scale, scale[1:], strict=False):
        out = out.when(height <= h1, color.mix(F.lit(c0).cast("long"), F.lit(c1).cast("long"), (height - float(h0)) / float(h1 - h0)))
    return out.otherwise(F.lit(scale[-1][1]).cast("long"))
