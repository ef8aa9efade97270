"""Texts to values, as columns: the value is null where the text is none, and a message says why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages that callers may compare.
NOT_FOUR, NOT_NUMBERS = "it should consist of 4 numbers", "it should consist of 4 comma-separated numbers"
LON_RANGE, LAT_RANGE = "longitude value is out of range", "latitude value is out of range"
LON_ORDER, LAT_ORDER = "max longitude value is smaller than min longitude value", "max latitude value is smaller than min latitude value"
#: A number at the start of a text.
FLOAT_PREFIX, INT_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", r"^([+-]?[0-9]+)"


def float_prefix(text: Column) -> Column:
    """The number that the text begins with; null if none. What follows is not looked at."""
    return F.nullif(F.regexp_extract(text, FLOAT_PREFIX, 1), F.lit("")).cast("double")


def int_prefix(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, INT_PREFIX, 1), F.lit("")).try_cast("int")


def number(text: Column) -> Column:
    """The whole text as a number, or null."""
    return F.trim(text).try_cast("double")


def floats(text: Column) -> Column:
    """Numbers between commas; null if one of them is none."""
    parts = F.transform(F.split(text, ","), number)
    return F.when(~F.exists(parts, lambda v: v.isNull()), parts)


def bounds(text: Column) -> tuple[Column, Column]:
    """min_lon, min_lat, max_lon, max_lat of 'a,b,c,d' as an array, and the error: one of both is null."""
    parts = F.transform(F.split(text, ","), number)
    a, b, c, d = (F.get(parts, F.lit(k)) for k in range(4))

    def off(v: Column, least: float, most: float) -> Column:
        return (v < least) | (v > most)

    error = F.when(F.size(parts) != 4, NOT_FOUR).when(F.exists(parts, lambda v: v.isNull()), NOT_NUMBERS)
    error = error.when(off(a, -179.0, 180.0) | off(c, -179.0, 180.0), LON_RANGE).when(off(b, -90.0, 90.0) | off(d, -90.0, 90.0), LAT_RANGE)
    error = error.when(a > c, LON_ORDER).when(b > d, LAT_ORDER).when(text.isNull(), NOT_FOUR)
    return F.when(error.isNull(), parts), error


def coverage(text: Column) -> Column:
    """Array of (lon, lat) of 'lon,lat,lon,lat...'; null if a part is no number or one is left over."""
    flat = floats(text)
    xs, ys = F.filter(flat, lambda v, i: i % 2 == 0), F.filter(flat, lambda v, i: i % 2 == 1)
    return F.when(F.size(flat) % 2 == 0, F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))))


def tile_id(text: Column) -> tuple[Column, Column, Column]:
    """level, tile_x and tile_y of l2e03n11; null where the text is no tile id."""
    pattern = "^l([0-9]+)([ew])([0-9]+)([ns])([0-9]+)$"
    level, x, y = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int") for k in (1, 3, 5))
    west, south = F.regexp_extract(text, pattern, 2) == "w", F.regexp_extract(text, pattern, 4) == "s"
    return level, F.when(west, -x).otherwise(x), F.when(south, -y).otherwise(y)


def positive_int(text: Column) -> Column:
    """1 and up, else null."""
    v = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.when(v >= 1, v)


def positive_float(text: Column) -> Column:
    v = number(text)
    return F.when(v > 0, v)


def collect_errors(*checks: tuple[Column, str]) -> Column:
    """Names of all checks that fail, in their order, as an array; a check that is null doesn't fail."""
    return F.array_compact(F.array(*[F.when(failed, name) for failed, name in checks]))


def svg_number(v: Column) -> Column:
    """At most two decimals, no zeros at the end, no zero before the point of a whole zero."""
    cents = F.round(F.abs(v) * 100, 0).cast("long")
    text = F.concat(F.floor(cents / 100).cast("string"), F.when(cents % 100 == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad((cents % 100).cast("string"), 2, "0"), "0$", ""))))
    return F.when((v < 0) & (cents != 0), F.concat(F.lit("-"), text)).otherwise(text)


def svg_path(letter: Column, numbers: Column) -> Column:
    """One path instruction: the letter, then its numbers; a space stands before each that isn't first or negative."""
    shown = F.transform(numbers, lambda v, i: F.concat(F.when((i == 0) | (v < 0), "").otherwise(" "), svg_number(v)))
    return F.concat(letter, F.array_join(shown, ""))


def svg_path_data(letters: Column, numbers: Column) -> Column:
    """Path data of instructions in order: arrays of letters (M L H V C S Q T A Z, also small) and of arrays of numbers."""
    return F.array_join(F.zip_with(letters, numbers, svg_path), "")
