"""Degrees, global cells, tiles, and the names of tiles. y grows north; a level-L tile spans 2**L degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cells_per_degree(tile_size: int, level: Column) -> Column:
    return F.lit(float(tile_size)) / F.pow(F.lit(2.0), level)


def lon_lat_to_cell(degrees: Column, tile_size: int, level: Column) -> Column:
    return degrees * cells_per_degree(tile_size, level)


def cell_to_lon_lat(cell: Column, tile_size: int, level: Column) -> Column:
    return cell / cells_per_degree(tile_size, level)


def cell_to_tile(cell: Column, tile_size: int) -> Column:
    return cell / F.lit(float(tile_size))


def tile_of_cell(cell: Column, tile_size: int) -> Column:
    return F.floor(cell / F.lit(float(tile_size))).cast("int")


def tile_bounds(tile_x: Column, tile_y: Column, level: Column) -> list[Column]:
    """min_lon, min_lat, max_lon, max_lat."""
    span = F.pow(F.lit(2.0), level)
    return [(tile_x * span).alias("min_lon"), (tile_y * span).alias("min_lat"), ((tile_x + 1) * span).alias("max_lon"), ((tile_y + 1) * span).alias("max_lat")]


def _signed(value: Column, positive: str, negative: str, digits: int) -> Column:
    return F.concat(F.when(value >= 0, positive).otherwise(negative), F.lpad(F.abs(value).cast("string"), digits, "0"))


def tile_name(tile_x: Column, tile_y: Column, lat_digits: int = 2) -> Column:
    """N46E015, or with three digits of latitude N046E015."""
    return F.concat(_signed(tile_y, "N", "S", lat_digits), _signed(tile_x, "E", "W", 3))


def tile_id_string(level: Column, tile_x: Column, tile_y: Column) -> Column:
    """l2e03n11."""
    return F.concat(F.lit("l"), level.cast("string"), _signed(tile_x, "e", "w", 2), _signed(tile_y, "n", "s", 2))


def parse_tile_name(name: Column) -> tuple[Column, Column]:
    """tile_x and tile_y of N46E015 and N046E015; null where the text is no name."""
    pattern = "^([NS])([0-9]{2,3})([EW])([0-9]{3})$"
    part = [F.regexp_extract(name, pattern, k) for k in range(1, 5)]
    ok = part[0] != ""
    number = [F.when(ok, p.cast("int")) for p in (F.nullif(part[1], F.lit("")), F.nullif(part[3], F.lit("")))]
    return F.when(part[2] == "W", -number[1]).otherwise(number[1]), F.when(part[0] == "S", -number[0]).otherwise(number[0])
