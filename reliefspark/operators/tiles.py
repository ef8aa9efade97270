"""Tile cover, pyramid closure, caching decisions and names of files, as set operations on tile relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import tile_name


def explode_grid(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, step: int = 1) -> DataFrame:
    """A row for each (tile_x, tile_y) of the closed ranges; an empty range gives none."""

    def steps(a: Column, b: Column) -> Column:
        return F.when(b >= a, F.sequence(a, b, F.lit(step)))

    return df.withColumn("tile_y", F.explode(steps(y0, y1))).withColumn("tile_x", F.explode(steps(x0, x1)))


def bounds_to_tiles(df: DataFrame, level: Column) -> DataFrame:
    """Tiles that cover min_lon, min_lat, max_lon, max_lat."""
    span = F.pow(F.lit(2.0), level)
    low = [F.floor(F.col(c) / span).cast("int") for c in ("min_lon", "min_lat")]
    high = [F.ceil(F.col(c) / span).cast("int") - 1 for c in ("max_lon", "max_lat")]
    return explode_grid(df, low[0], high[0], low[1], high[1])


def bounds_to_files(df: DataFrame, degrees: int = 3) -> DataFrame:
    """Files of `degrees` by `degrees`, by their south-west corner."""
    low = [(F.floor(F.col(c) / degrees) * degrees).cast("int") for c in ("min_lon", "min_lat")]
    high = [(F.ceil(F.col(c) / degrees) * degrees - degrees).cast("int") for c in ("max_lon", "max_lat")]
    return explode_grid(df, low[0], high[0], low[1], high[1], degrees)


def containing_file(tile: Column, degrees: int = 3, compat: bool = False) -> Column:
    """South or west edge of the file that holds a 1-degree tile. compat moves exact negative multiples one file down, as
    the older data layout had it."""
    right = F.floor(tile / F.lit(degrees)) * degrees
    return F.when((tile < 0) & (tile % degrees == 0), tile - degrees).otherwise(right).cast("int") if compat else right.cast("int")


def children(tiles: DataFrame, wide: bool = False) -> DataFrame:
    """The 2x2 tiles (4x4 around them, if wide) of the level below."""
    a, n = (-1, 4) if wide else (0, 2)
    steps = F.array(*[F.lit(a + k) for k in range(n)])
    out = tiles.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return out.select((F.col("level") - 1).alias("level"), (F.col("tile_x") * 2 + F.col("dx")).alias("tile_x"), (F.col("tile_y") * 2 + F.col("dy")).alias("tile_y"))


def required_closure(tiles: DataFrame, cached: DataFrame | None = None, max_level: int = 6) -> DataFrame:
    """All tiles that must be there to build the given ones: level by level, each the children of what the level above
    needs; tiles that are cached need no children. max_level anti joins and unions, whatever the number of tiles."""
    need = tiles.select("level", "tile_x", "tile_y").distinct()
    out = need
    for level in range(max_level, 0, -1):
        here = out.where(F.col("level") == level)
        if cached is not None:
            here = here.join(cached.select("level", "tile_x", "tile_y"), ["level", "tile_x", "tile_y"], "left_anti")
        out = out.unionByName(children(here)).distinct()
    return out


def tile_status(level: Column, png_cached: Column, none_marker: Column, source_exists: Column) -> Column:
    """Cached, NotCached or NotExists."""
    return F.when(png_cached, "Cached").when(level == 0, F.when(source_exists, "NotCached").otherwise("NotExists")).when(none_marker, "NotExists").otherwise("NotCached")


def water_cache_status(png: Column, none_marker: Column, available: Column) -> Column:
    return F.when(png, "Cached").when(none_marker, "CachedAsNone").when(available, "Download").otherwise("NotExists")


def write_decision(level: Column, is_empty: Column) -> Column:
    """What the cache gets for a tile: a raster, a marker that there is none, or nothing."""
    return F.when(~is_empty, "raster").when(level > 0, "none-marker").otherwise("nothing")


def split_intervals(df: DataFrame, low: Column, high: Column, size: Column) -> DataFrame:
    """index, interval_min, interval_max; the last one may be short."""
    count = F.ceil((high - low) / size).cast("int")
    out = df.withColumn("index", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    return out.withColumn("interval_min", low + F.col("index") * size).withColumn("interval_max", F.least(low + (F.col("index") + 1) * size, high))


def source_archive_name(tile_x: Column, tile_y: Column) -> Column:
    return F.concat(tile_name(tile_x, tile_y), F.lit(".SRTMGL1.hgt.zip"))


def cache_file_name(level: Column, tile_x: Column, tile_y: Column) -> Column:
    return F.concat(level.cast("string"), F.lit("/"), tile_name(tile_x, tile_y), F.lit(".png"))


# Fixed value: where the 30 m elevation tiles are published, in groups of 5 by 5 degrees.
AW3D_URL = "https://www.eorc.jaxa.jp/ALOS/aw3d30/data/release_v2404"


def elevation_url(tile_x: Column, tile_y: Column) -> Column:
    group = [(F.floor(c / 5) * 5).cast("int") for c in (tile_x, tile_y)]
    return F.concat(F.lit(AW3D_URL + "/"), tile_name(*group, 3), F.lit("/"), tile_name(tile_x, tile_y, 3), F.lit(".zip"))


def image_tile_name(prefix: str, x: Column, y: Column, max_x: int, max_y: int) -> Column:
    """prefix-XX-YY.png, padded to the digits of the largest index."""

    def padded(c: Column, most: int) -> Column:
        return F.lpad(c.cast("string"), max(1, len(str(most))), "0")

    return F.concat(F.lit(prefix + "-"), padded(x, max_x), F.lit("-"), padded(y, max_y), F.lit(".png"))


def raster_grid(rects: DataFrame, size: int) -> DataFrame:
    """rects (min_x, min_y, width, height, ...) with (tx, ty) of each tile of `size` pixels, and the last of both."""
    a = split_intervals(rects, F.col("min_x"), F.col("min_x") + F.col("width"), F.lit(size)).withColumnRenamed("index", "tx").drop("interval_min", "interval_max")
    b = split_intervals(a, F.col("min_y"), F.col("min_y") + F.col("height"), F.lit(size)).withColumnRenamed("index", "ty").drop("interval_min", "interval_max")
    return b.withColumn("max_tx", (F.ceil(F.col("width") / size) - 1).cast("int")).withColumn("max_ty", (F.ceil(F.col("height") / size) - 1).cast("int"))


def valid_tile(level: Column, tile_x: Column, tile_y: Column) -> Column:
    """(level, tile_x, tile_y) as a struct; a level below 0 raises."""
    return F.when(level >= 0, F.struct(level.alias("level"), tile_x.alias("tile_x"), tile_y.alias("tile_y"))).otherwise(F.raise_error(F.concat(F.lit("level "), level.cast("string"))))


def level_zero(tiles: DataFrame) -> DataFrame:
    """(tile_x, tile_y) of tiles of level 0; one of a higher level raises."""
    x = F.when(F.col("level") == 0, F.col("tile_x")).otherwise(F.raise_error(F.lit("not a tile of level 0")))
    return tiles.select(x.alias("tile_x"), "tile_y")


def tile_parts(cells: DataFrame, size: int) -> DataFrame:
    """cells (x, y, h) of a large tile dealt to tiles of `size` cells: tile_x, tile_y, x and y within the tile, h."""
    tx, ty = (F.floor(F.col(c) / size).cast("int") for c in "xy")
    return cells.select(tx.alias("tile_x"), ty.alias("tile_y"), (F.col("x") - tx * size).cast("int").alias("x"), (F.col("y") - ty * size).cast("int").alias("y"), "h")


def block_range(low: Column, length: Column, size: int, total: int) -> tuple[Column, Column]:
    """First and last of the blocks of `size` along one axis of `total` that a window touches."""
    return F.floor(low / size).cast("int"), F.floor(F.least(low + length, F.lit(total - 1)) / size).cast("int")
