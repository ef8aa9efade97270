"""Colours packed as r << 24 | g << 16 | b << 8 | a in a BIGINT, and compositing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import ratio_to_byte_round

RED, GREEN, BLUE, ALPHA = 24, 16, 8, 0


def channel(c: Column, shift: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND(F.lit(255)) if shift else c.bitwiseAND(F.lit(255))


def channels(c: Column) -> tuple[Column, Column, Column, Column]:
    return channel(c, RED), channel(c, GREEN), channel(c, BLUE), channel(c, ALPHA)


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    big = [x.cast("long") for x in (r, g, b, a)]
    return big[0] * (1 << 24) + big[1] * (1 << 16) + big[2] * (1 << 8) + big[3]


def literal(r: int, g: int, b: int, a: int = 255) -> int:
    return r << 24 | g << 16 | b << 8 | a


def with_alpha(c: Column, a: Column) -> Column:
    return c - channel(c, ALPHA) + a.cast("long")


def to_argb(c: Column) -> Column:
    r, g, b, a = channels(c)
    return pack(a, r, g, b)


def to_hex(c: Column) -> Column:
    """#rrggbb, or #aarrggbb if not opaque."""
    r, g, b, a = channels(c)
    return F.when(a == 255, F.format_string("#%02x%02x%02x", r, g, b)).otherwise(F.format_string("#%02x%02x%02x%02x", a, r, g, b))


def parse_hex(text: Column) -> Column:
    """Six digits, or eight with alpha first; what follows is not looked at; else null."""
    digits = F.regexp_extract(text, "^#([0-9a-fA-F]{8}|[0-9a-fA-F]{6})", 1)
    argb = F.when(F.length(digits) == 8, digits).when(F.length(digits) == 6, F.concat(F.lit("ff"), digits))
    value = F.conv(argb, 16, 10).cast("long")
    return (value % (1 << 24)) * 256 + F.shiftright(value, 24)


def mix(a: Column, b: Column, ratio: Column) -> Column:
    """Channels in between, truncated; exactly a at 0 and b at 1."""
    parts = [((y - x) * ratio + x).cast("int") for x, y in zip(channels(a), channels(b), strict=True)]
    return F.when(ratio == 0.0, a).when(ratio == 1.0, b).otherwise(pack(*parts))


def distance(a: Column, b: Column) -> Column:
    d = [(x - y).cast("double") for x, y in zip(channels(a), channels(b), strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + d[3] * d[3])


def premultiplied(c: Column) -> tuple[Column, Column, Column]:
    r, g, b, a = channels(c)
    return tuple((x * a).cast("double") / 65025.0 for x in (r, g, b))


def over(source: Column, dest: Column) -> Column:
    """Porter-Duff source over dest; the transparent and the opaque pass unchanged."""
    sa, da = channel(source, ALPHA), channel(dest, ALPHA)
    sr, dr = sa / 255.0, da / 255.0
    out_a = F.when(da == 255, F.lit(1.0)).otherwise(sr + dr * (1.0 - sr))
    mixed = [s + d * (1.0 - sr) for s, d in zip(premultiplied(source), premultiplied(dest), strict=True)]
    blend = pack(*[ratio_to_byte_round(m / out_a) for m in mixed], ratio_to_byte_round(out_a))
    return F.when(sa == 0, dest).when(sa == 255, source).when(da == 0, source).otherwise(blend)


def darken(source: Column, dest: Column) -> Column:
    """Alphas as darkness, combined; the colour is black."""
    s, d = channel(source, ALPHA) / 255.0, channel(dest, ALPHA) / 255.0
    return ratio_to_byte_round(1.0 - (1.0 - s) * (1.0 - d)).cast("long")
