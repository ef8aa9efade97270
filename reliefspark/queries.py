"""Registered queries, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixtures as fx
from .functions import angles, arith, color, coords, parse, projections, terrain
from .operators import contours, geometry, raster, tiles, water
from .plans import shading
from .sources import archives, grids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col
DEM, PARTS, COVER = fx.dem_sql(), fx.parts_sql(), fx.cover_sql()
PI = "3.141592653589793"


def query(name: str, source: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a function of the relation `source`; sql sees that relation as t."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(fx.relation(spark, sf_dir, source))
        if sql:
            ORACLE_SQL[name] = f"WITH t AS ({source})" + (", " if sql.lstrip().startswith("--with") else " ") + sql.replace("--with", "")
        return f

    return add


# --- colours and compositing -----------------------------------------------------------------------------------------


def ch(x: str) -> tuple[str, str, str, str]:
    return tuple(f"(({x} >> {k}) & 255)" for k in (24, 16, 8, 0))


def packed(r: str, g: str, b: str, a: str) -> str:
    return f"(CAST({r} AS BIGINT) * 16777216 + CAST({g} AS BIGINT) * 65536 + CAST({b} AS BIGINT) * 256 + CAST({a} AS BIGINT))"


def mixed(a: str, b: str, r: str) -> str:
    parts = [f"trunc(({y} - {x}) * ({r}) + {x})" for x, y in zip(ch(a), ch(b), strict=True)]
    return f"CASE WHEN ({r}) = 0 THEN {a} WHEN ({r}) = 1 THEN {b} ELSE {packed(*parts)} END"


def byte_round(x: str) -> str:
    return f"least(greatest(CAST(round_even(({x}) * 255.0::DOUBLE, 0) AS BIGINT), 0), 255)"


def byte_trunc(x: str) -> str:
    return f"least(greatest(CAST(trunc(({x}) * 255.0::DOUBLE) AS BIGINT), 0), 255)"


def over_sql(s: str, d: str) -> str:
    sa, da = ch(s)[3], ch(d)[3]
    sr, dr = f"({sa} / 255.0::DOUBLE)", f"({da} / 255.0::DOUBLE)"
    out = f"(CASE WHEN {da} = 255 THEN 1.0::DOUBLE ELSE {sr} + {dr} * (1.0::DOUBLE - {sr}) END)"
    parts = [byte_round(f"(({x} * {sa}) / 65025.0::DOUBLE + (({y} * {da}) / 65025.0::DOUBLE) * (1.0::DOUBLE - {sr})) / {out}") for x, y in zip(ch(s)[:3], ch(d)[:3], strict=True)]
    return f"CASE WHEN {sa} = 0 THEN {d} WHEN {sa} = 255 THEN {s} WHEN {da} = 0 THEN {s} ELSE {packed(*parts, byte_round(out))} END"


def darken_sql(s: str, d: str) -> str:
    return byte_round(f"1.0::DOUBLE - (1.0::DOUBLE - {ch(s)[3]} / 255.0::DOUBLE) * (1.0::DOUBLE - {ch(d)[3]} / 255.0::DOUBLE)")


@query("color_unpack", fx.COLORS, "SELECT id, " + ", ".join(f"{x} AS {n}" for x, n in zip(ch("c1"), "rgba", strict=True)) + " FROM t")
def _(t):
    return t.select("id", *[x.alias(n) for x, n in zip(color.channels(c("c1")), "rgba", strict=True)])


@query("color_pack", fx.COLORS, f"SELECT id, {packed(ch('c1')[0], ch('c2')[1], ch('c1')[2], ch('c2')[3])} AS rgba FROM t")
def _(t):
    a, b = color.channels(c("c1")), color.channels(c("c2"))
    return t.select("id", color.pack(a[0], b[1], a[2], b[3]).alias("rgba"))


@query("color_with_alpha", fx.COLORS, f"SELECT id, c1 - {ch('c1')[3]} + {ch('c2')[3]} AS rgba FROM t")
def _(t):
    return t.select("id", color.with_alpha(c("c1"), color.channel(c("c2"), color.ALPHA)).alias("rgba"))


@query("color_to_argb", fx.COLORS, f"SELECT id, {packed(ch('c1')[3], *ch('c1')[:3])} AS argb FROM t")
def _(t):
    return t.select("id", color.to_argb(c("c1")).alias("argb"))


_HEX = "'#' || CASE WHEN {a} = 255 THEN '' ELSE lpad(lower(to_hex({a})), 2, '0') END || lpad(lower(to_hex({r})), 2, '0') || lpad(lower(to_hex({g})), 2, '0') || lpad(lower(to_hex({b})), 2, '0')".format(**dict(zip("rgba", ch("c1"), strict=True)))


@query("color_to_hex", fx.COLORS, f"SELECT id, {_HEX} AS hex FROM t")
def _(t):
    return t.select("id", color.to_hex(c("c1")).alias("hex"))


@query("color_parse_hex", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN '#12' WHEN p_size % 2 = 0 THEN '#' || lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR(10)), 6, 'a') ELSE '#F0' || lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR(10)), 6, 'B') END AS txt FROM part", """
SELECT id, CASE WHEN length(txt) = 7 THEN CAST('0x' || substr(txt, 2) AS BIGINT) * 256 + 255 WHEN length(txt) = 9 THEN CAST('0x' || substr(txt, 4) AS BIGINT) * 256 + CAST('0x' || substr(txt, 2, 2) AS BIGINT) END AS rgba FROM t""")
def _(t):
    return t.select("id", color.parse_hex(c("txt")).alias("rgba"))


@query("color_mix", fx.COLORS, f"SELECT id, {mixed('c1', 'c2', 'ratio')} AS rgba FROM t")
def _(t):
    return t.select("id", color.mix(c("c1"), c("c2"), c("ratio")).alias("rgba"))


@query("color_distance", fx.COLORS, "SELECT id, round(sqrt(" + " + ".join(f"power(CAST({a} - {b} AS DOUBLE), 2)" for a, b in zip(ch("c1"), ch("c2"), strict=True)) + "), 9) AS d FROM t")
def _(t):
    return t.select("id", F.round(color.distance(c("c1"), c("c2")), 9).alias("d"))


@query("color_premultiply", fx.COLORS, "SELECT id, " + ", ".join(f"round(CAST({x} * {ch('c1')[3]} AS DOUBLE) / 65025.0, 9) AS {n}" for x, n in zip(ch("c1")[:3], ("pr", "pg", "pb"), strict=True)) + " FROM t")
def _(t):
    return t.select("id", *[F.round(x, 9).alias(n) for x, n in zip(color.premultiplied(c("c1")), ("pr", "pg", "pb"), strict=True)])


@query("composite_over", fx.COLORS, f"SELECT id, {over_sql('c1', 'c2')} AS rgba FROM t")
def _(t):
    return t.select("id", color.over(c("c1"), c("c2")).alias("rgba"))


@query("composite_darken", fx.COLORS, f"SELECT id, {darken_sql('c1', 'c2')} AS rgba FROM t")
def _(t):
    return t.select("id", color.darken(c("c1"), c("c2")).alias("rgba"))


# --- angles and tolerance --------------------------------------------------------------------------------------------


def norm_sql(a: str, n: str) -> str:
    return f"(CASE WHEN ({a}) % {n} < 0 THEN ({a}) % {n} + {n} ELSE ({a}) % {n} END)"


def diff_sql(a: str, b: str, n: str) -> str:
    d = f"abs({norm_sql(a, n)} - {norm_sql(b, n)})"
    return f"(CASE WHEN {d} > {n} / 2 THEN {n} - {d} ELSE {d} END)"


_EV = "SELECT event_id, value * 7.5 - 400 AS a, value * 3.25 AS b FROM events"


@query("angle_normalize", _EV, f"SELECT event_id, round({norm_sql('a', '360.0::DOUBLE')}, 6) AS angle FROM t")
def _(t):
    return t.select("event_id", F.round(angles.normalize(c("a"), 360.0), 6).alias("angle"))


@query("angle_difference", _EV, f"SELECT event_id, round({diff_sql('a', 'b', '360.0::DOUBLE')}, 6) AS diff FROM t")
def _(t):
    return t.select("event_id", F.round(angles.difference(c("a"), c("b"), 360.0), 6).alias("diff"))


@query("circular_mean", fx.ANGLES, "SELECT user_id, round(atan2(sum(sin(a)), sum(cos(a))), 6) AS mean_angle FROM t GROUP BY user_id")
def _(t):
    return t.groupBy("user_id").agg(F.round(angles.circular_mean(c("a"), 1e-9), 6).alias("mean_angle"))


@query("tolerant_compare", "SELECT event_id, value AS a, round(value, 0) AS b FROM events", "SELECT event_id, CASE WHEN abs(a - b) <= 0.1 THEN 0 WHEN a < b THEN -1 ELSE 1 END AS cmp FROM t")
def _(t):
    return t.select("event_id", arith.tolerant_compare(c("a"), c("b"), 0.1).alias("cmp"))


# --- coordinates and tiles -------------------------------------------------------------------------------------------


@query("lonlat_to_cell", fx.POINTS, "SELECT id, round(lon * (3600.0 / power(2, level)), 6) AS cell_x, round(lat * (3600.0 / power(2, level)), 6) AS cell_y FROM t")
def _(t):
    return t.select("id", *[F.round(coords.lon_lat_to_cell(c(a), 3600, c("level")), 6).alias(b) for a, b in (("lon", "cell_x"), ("lat", "cell_y"))])


@query("cell_to_lonlat", "SELECT o_orderkey AS id, o_orderkey * 31 % 100000 - 50000 AS cx, o_custkey * 17 % 90000 - 45000 AS cy, CAST(o_orderkey % 7 AS INT) AS level FROM orders", "SELECT id, round(cx / (3600.0::DOUBLE / power(2, level)), 9) AS lon, round(cy / (3600.0::DOUBLE / power(2, level)), 9) AS lat FROM t")
def _(t):
    return t.select("id", *[F.round(coords.cell_to_lon_lat(c(a), 3600, c("level")), 9).alias(b) for a, b in (("cx", "lon"), ("cy", "lat"))])


@query("cell_to_tile", "SELECT o_orderkey AS id, o_orderkey * 31 % 100000 - 50000 AS cx FROM orders", "SELECT id, round(cx / 3600.0::DOUBLE, 9) AS tx, CAST(floor(cx / 3600.0::DOUBLE) AS INT) AS tile_x FROM t")
def _(t):
    return t.select("id", F.round(coords.cell_to_tile(c("cx"), 3600), 9).alias("tx"), coords.tile_of_cell(c("cx"), 3600).alias("tile_x"))


@query("tile_of_cell", fx.POINTS, "SELECT id, CAST(floor(lon * 1200 / 3600.0::DOUBLE) AS INT) AS tile_x, CAST(floor(lat * 1200 / 3600.0::DOUBLE) AS INT) AS tile_y FROM t")
def _(t):
    return t.select("id", coords.tile_of_cell(c("lon") * 1200, 3600).alias("tile_x"), coords.tile_of_cell(c("lat") * 1200, 3600).alias("tile_y"))


@query("tile_bounds", fx.TILES, "SELECT id, tile_x * power(2.0::DOUBLE, level) AS min_lon, tile_y * power(2.0::DOUBLE, level) AS min_lat, (tile_x + 1) * power(2.0::DOUBLE, level) AS max_lon, (tile_y + 1) * power(2.0::DOUBLE, level) AS max_lat FROM t")
def _(t):
    return t.select("id", *coords.tile_bounds(c("tile_x"), c("tile_y"), c("level")))


_LETTER = "(CASE WHEN {v} >= 0 THEN '{p}' ELSE '{n}' END || lpad(CAST(abs({v}) AS VARCHAR), {d}, '0'))"


def name_sql(x: str, y: str, d: int = 2) -> str:
    return "(" + _LETTER.format(v=y, p="N", n="S", d=d) + " || " + _LETTER.format(v=x, p="E", n="W", d=3) + ")"


@query("tile_name_format", fx.TILES, f"SELECT id, {name_sql('tile_x', 'tile_y')} AS name2, {name_sql('tile_x', 'tile_y', 3)} AS name3, 'l' || level || {_LETTER.format(v='tile_x', p='e', n='w', d=2)} || {_LETTER.format(v='tile_y', p='n', n='s', d=2)} AS id_string FROM t")
def _(t):
    x, y = c("tile_x"), c("tile_y")
    return t.select("id", coords.tile_name(x, y).alias("name2"), coords.tile_name(x, y, 3).alias("name3"), coords.tile_id_string(c("level"), x, y).alias("id_string"))


@query("tile_name_parse", f"SELECT id, CASE WHEN id % 6 = 0 THEN 'X10E10' ELSE {name_sql('tile_x', 'tile_y').replace('VARCHAR', 'VARCHAR(9)')} END AS name FROM ({fx.TILES}) AS q", "SELECT id, CASE WHEN name[1] IN ('N', 'S') THEN CAST(substr(name, 5, 3) AS INT) * CASE WHEN name[4] = 'W' THEN -1 ELSE 1 END END AS tile_x, CASE WHEN name[1] IN ('N', 'S') THEN CAST(substr(name, 2, 2) AS INT) * CASE WHEN name[1] = 'S' THEN -1 ELSE 1 END END AS tile_y FROM t")
def _(t):
    x, y = coords.parse_tile_name(c("name"))
    return t.select("id", x.alias("tile_x"), y.alias("tile_y"))


_GRID = "CROSS JOIN LATERAL (SELECT unnest(generate_series({x0}, {x1}, {s})) AS tile_x) CROSS JOIN LATERAL (SELECT unnest(generate_series({y0}, {y1}, {s})) AS tile_y)"


@query("bounds_to_tiles", fx.BOUNDS, "SELECT id, level, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y FROM t " + _GRID.format(x0="CAST(floor(min_lon / power(2, level)) AS INT)", x1="CAST(ceil(max_lon / power(2, level)) AS INT) - 1", y0="CAST(floor(min_lat / power(2, level)) AS INT)", y1="CAST(ceil(max_lat / power(2, level)) AS INT) - 1", s=1))
def _(t):
    return tiles.bounds_to_tiles(t, c("level")).select("id", "level", "tile_x", "tile_y")


@query("bounds_to_3deg_files", fx.BOUNDS, "SELECT id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y FROM t " + _GRID.format(x0="CAST(floor(min_lon / 3) * 3 AS INT)", x1="CAST(ceil(max_lon / 3) * 3 - 3 AS INT)", y0="CAST(floor(min_lat / 3) * 3 AS INT)", y1="CAST(ceil(max_lat / 3) * 3 - 3 AS INT)", s=3))
def _(t):
    return tiles.bounds_to_files(t).select("id", "tile_x", "tile_y")


@query("containing_3deg_file", fx.TILES, "SELECT id, CAST(floor(tile_x / 3.0) * 3 AS INT) AS file_x, CAST(floor(tile_y / 3.0) * 3 AS INT) AS file_y, CAST(CASE WHEN tile_y < 0 AND tile_y % 3 = 0 THEN tile_y - 3 ELSE floor(tile_y / 3.0) * 3 END AS INT) AS compat_y FROM t")
def _(t):
    return t.select("id", tiles.containing_file(c("tile_x")).alias("file_x"), tiles.containing_file(c("tile_y")).alias("file_y"), tiles.containing_file(c("tile_y"), compat=True).alias("compat_y"))


@query("split_intervals", "SELECT o_orderkey AS id, CAST(o_custkey % 100 AS INT) AS low, CAST(o_custkey % 100 + o_orderkey % 200 AS INT) AS high, CAST(20 + o_orderkey % 30 AS INT) AS size FROM orders", "SELECT id, CAST(i AS INT) AS idx, CAST(low + i * size AS INT) AS interval_min, CAST(least(low + (i + 1) * size, high) AS INT) AS interval_max FROM t CROSS JOIN LATERAL (SELECT unnest(range((high - low + size - 1) // size)) AS i)")
def _(t):
    return tiles.split_intervals(t, c("low"), c("high"), c("size")).select("id", c("index").alias("idx"), "interval_min", "interval_max")


@query("raster_tile_grid", fx.RECTS, "SELECT id, CAST(i AS INT) AS tx, CAST(j AS INT) AS ty, CAST((width + 9) // 10 - 1 AS INT) AS max_tx, CAST((height + 9) // 10 - 1 AS INT) AS max_ty FROM t CROSS JOIN LATERAL (SELECT unnest(range((width + 9) // 10)) AS i) CROSS JOIN LATERAL (SELECT unnest(range((height + 9) // 10)) AS j)")
def _(t):
    return tiles.raster_grid(t, 10).select("id", "tx", "ty", "max_tx", "max_ty")


@query("raster_mbr", fx.POINTS, f"SELECT level, CAST(floor(min(lon * {PI} / 180 * 1000)) AS INT) AS min_x, CAST(floor(round(min(ln(tan({PI} / 4 + lat * {PI} / 180 / 2)) * 1000), 6)) AS INT) AS min_y, CAST(ceil(max(lon * {PI} / 180 * 1000)) AS INT) AS max_x, CAST(ceil(round(max(ln(tan({PI} / 4 + lat * {PI} / 180 / 2)) * 1000), 6)) AS INT) AS max_y FROM t WHERE abs(lat * {PI} / 180) <= 1.48442222974533 GROUP BY level")
def _(t):
    return projections.projected_mbr(t, projections.Mercator(1000.0), "level")


@query("rect_inflate", fx.RECTS, "SELECT id, min_x - 3 AS min_x, min_y - 3 AS min_y, width + 6 AS width, height + 6 AS height FROM t")
def _(t):
    return t.select("id", *[v.alias(n) for v, n in zip(geometry.inflate(c("min_x"), c("min_y"), c("width"), c("height"), 3), ("min_x", "min_y", "width", "height"), strict=True)])


@query("rect_intersect_join", fx.RECTS, "SELECT a.id AS a_id, b.id AS b_id FROM t a JOIN t b ON a.id < b.id AND a.min_x <= b.min_x + b.width AND a.min_x + a.width >= b.min_x AND a.min_y <= b.min_y + b.height AND a.min_y + a.height >= b.min_y")
def _(t):
    return geometry.rect_join(t, t, 64).where("a_id < b_id")


@query("interval_overlap_join", fx.INTERVALS, "SELECT a.id AS a_id, b.id AS b_id FROM t a JOIN t b ON a.id < b.id AND a.low <= b.high AND a.high >= b.low")
def _(t):
    return geometry.interval_join(t, t, 64).where("a_id < b_id")


@query("bounds_inside", fx.POINTS, "SELECT id, lon >= -20 AND lon <= 40 AND lat >= -10 AND lat <= 50 AS inside FROM t")
def _(t):
    return t.select("id", (c("lon").between(-20, 40) & c("lat").between(-10, 50)).alias("inside"))


@query("bounds_mbr", fx.POINTS, "SELECT level, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM t GROUP BY level")
def _(t):
    return geometry.mbr(t, "level")


@query("points_all_inside", fx.POINTS, "SELECT level, bool_and(lon >= -180 AND lon < 180 AND lat >= -80 AND lat < 79.99) AS all_inside FROM t GROUP BY level")
def _(t):
    return t.groupBy("level").agg(F.bool_and((c("lon") >= -180) & (c("lon") < 180) & (c("lat") >= -80) & (c("lat") < 79.99)).alias("all_inside"))


@query("coords_to_points", fx.POINTS, "SELECT id, k, CASE WHEN k = 0 THEN lon ELSE lat END AS x, CASE WHEN k = 0 THEN lat ELSE lon END AS y FROM t CROSS JOIN (VALUES (0), (1)) AS v(k)")
def _(t):
    return t.select("id", F.posexplode(geometry.points_of(F.array("lon", "lat", "lat", "lon")))).select("id", c("pos").alias("k"), c("col.x").alias("x"), c("col.y").alias("y"))


@query("tile_children", fx.TILES, "SELECT level - 1 AS level, tile_x * 2 + dx AS tile_x, tile_y * 2 + dy AS tile_y FROM t CROSS JOIN (VALUES (0), (1)) AS a(dx) CROSS JOIN (VALUES (0), (1)) AS b(dy)")
def _(t):
    return tiles.children(t)


@query("tiles_required_closure", fx.TILES)
def _(t):
    return tiles.required_closure(t)


ORACLE_SQL["tiles_required_closure"] = f"WITH RECURSIVE t AS ({fx.TILES}), r(level, tile_x, tile_y) AS (SELECT level, tile_x, tile_y FROM t UNION SELECT level - 1, tile_x * 2 + dx, tile_y * 2 + dy FROM r CROSS JOIN (VALUES (0), (1)) AS a(dx) CROSS JOIN (VALUES (0), (1)) AS b(dy) WHERE level > 0) SELECT DISTINCT * FROM r"
_CAT = "SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS level, o_orderkey % 3 = 0 AS png, o_custkey % 5 = 0 AS none_marker, o_custkey % 2 = 0 AS source FROM orders"


@query("tile_status", _CAT, "SELECT id, CASE WHEN png THEN 'Cached' WHEN level = 0 THEN CASE WHEN source THEN 'NotCached' ELSE 'NotExists' END WHEN none_marker THEN 'NotExists' ELSE 'NotCached' END AS status FROM t")
def _(t):
    return t.select("id", tiles.tile_status(c("level"), c("png"), c("none_marker"), c("source")).alias("status"))


@query("water_cache_status", _CAT, "SELECT id, CASE WHEN png THEN 'Cached' WHEN none_marker THEN 'CachedAsNone' WHEN source THEN 'Download' ELSE 'NotExists' END AS status FROM t")
def _(t):
    return t.select("id", tiles.water_cache_status(c("png"), c("none_marker"), c("source")).alias("status"))


@query("cache_write_decision", _CAT, "SELECT id, CASE WHEN NOT none_marker THEN 'raster' WHEN level > 0 THEN 'none-marker' ELSE 'nothing' END AS decision FROM t")
def _(t):
    return t.select("id", tiles.write_decision(c("level"), c("none_marker")).alias("decision"))


@query("import_plan", _CAT, "SELECT id FROM t WHERE level = 0 AND NOT png AND source")
def _(t):
    level0 = t.where("level = 0")
    return level0.join(t.where("png").select("id"), "id", "left_anti").join(t.where("source").select("id"), "id", "left_semi").select("id")


@query("available_tiles_semi", f"SELECT a.tile_x, a.tile_y, b.id AS have FROM ({fx.TILES}) a LEFT JOIN ({fx.TILES}) b ON a.tile_x + 1 = b.tile_x", "SELECT DISTINCT tile_x, tile_y FROM t WHERE have IS NOT NULL")
def _(t):
    return t.select("tile_x", "tile_y").distinct().join(t.where("have is not null"), ["tile_x", "tile_y"], "left_semi")


@query("tile_paths", fx.TILES, f"SELECT id, {name_sql('tile_x', 'tile_y')} || '.SRTMGL1.hgt.zip' AS archive, level || '/' || {name_sql('tile_x', 'tile_y')} || '.png' AS cached FROM t")
def _(t):
    x, y = c("tile_x"), c("tile_y")
    return t.select("id", tiles.source_archive_name(x, y).alias("archive"), tiles.cache_file_name(c("level"), x, y).alias("cached"))


@query("aw3d_tile_url", fx.TILES, f"SELECT id, '{tiles.AW3D_URL}/' || {name_sql('CAST(floor(tile_x / 5.0) * 5 AS INT)', 'CAST(floor(tile_y / 5.0) * 5 AS INT)', 3)} || '/' || {name_sql('tile_x', 'tile_y', 3)} || '.zip' AS url FROM t")
def _(t):
    return t.select("id", tiles.elevation_url(c("tile_x"), c("tile_y")).alias("url"))


@query("tile_file_names", "SELECT p_partkey AS id, p_partkey % 120 AS tx, p_size AS ty FROM part", "SELECT id, 'shading-' || lpad(CAST(tx AS VARCHAR), 3, '0') || '-' || lpad(CAST(ty AS VARCHAR), 2, '0') || '.png' AS name FROM t")
def _(t):
    return t.select("id", tiles.image_tile_name("shading", c("tx"), c("ty"), 119, 50).alias("name"))


# --- raster algebra --------------------------------------------------------------------------------------------------


@query("raster_init_2d", "SELECT n_nationkey AS id FROM nation", "SELECT CAST(i % 40 AS INT) AS x, CAST(i // 40 AS INT) AS y, CAST((i % 40) * 3 + (i // 40) * 5 AS INT) AS h FROM (SELECT unnest(range(40 * 30)) AS i)")
def _(t):
    return raster.canvas(t.sparkSession, 0, 0, 40, 30).withColumn("h", c("x") * 3 + c("y") * 5)


@query("mosaic_merge", PARTS, "SELECT x, y, arg_max_null(h, src_ord) AS h FROM t GROUP BY x, y")
def _(t):
    return raster.merge(t)


_BOX = "b AS (SELECT CAST(i % 30 + {x} AS INT) AS x, CAST(i // 30 + {y} AS INT) AS y FROM (SELECT unnest(range(30 * 20)) AS i))"


@query("mosaic_fetch", PARTS, "--with" + _BOX.format(x=50, y=55) + ", m AS (SELECT x, y, arg_max_null(h, -src_ord) AS h FROM t GROUP BY x, y) SELECT x, y, h FROM b LEFT JOIN m USING (x, y)")
def _(t):
    return raster.merge(t.withColumn("src_ord", -c("src_ord")), (50, 55, 30, 20))


@query("raster_extract", DEM, "--with" + _BOX.format(x=-5, y=50) + " SELECT x, y, h FROM b LEFT JOIN t USING (x, y)")
def _(t):
    return raster.extract(t, -5, 50, 30, 20)


@query("raster_map", DEM, "SELECT x, y, CASE WHEN h IS NULL THEN NULL WHEN h > 1000 THEN h - 1000 ELSE h * 2 END AS h FROM t")
def _(t):
    return t.withColumn("h", F.when(c("h") > 1000, c("h") - 1000).otherwise(c("h") * 2))


_N9 = "n AS (SELECT a.x, a.y, a.h, " + ", ".join(f"max(CASE WHEN b.x = a.x + {k % 3 - 1} AND b.y = a.y + {k // 3 - 1} THEN b.h END) AS n{k}" for k in range(9)) + " FROM {s} a JOIN {s} b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.x, a.y, a.h)"
_SUM9 = " + ".join(f"coalesce(n{k}, 0)" for k in range(9)) + " + coalesce(n4, 0)"


@query("focal_sum_3x3", DEM, f"--with{_N9.format(s='t')} SELECT x, y, CAST({_SUM9} AS BIGINT) AS total FROM n")
def _(t):
    return raster.focal_sum(raster.extract(t, 0, 0, 64, 64)).join(t.select("x", "y"), ["x", "y"], "left_semi")


@query("raster_simplify", COVER, f"--withm AS (SELECT x, y, CASE WHEN h = 80 THEN 1 ELSE 0 END AS h FROM t), {_N9.format(s='m')} SELECT x, y, CASE WHEN {_SUM9} <= 3 THEN 0 WHEN {_SUM9} >= 7 THEN 1 ELSE n4 END AS h FROM n")
def _(t):
    dense = raster.extract(t.withColumn("h", water.monochrome(c("h"))), 0, 0, 64, 64)
    return raster.simplify_step(dense).join(t.select("x", "y"), ["x", "y"], "left_semi")


@query("height_histogram", DEM, "SELECT h, count(*) AS n FROM t GROUP BY h")
def _(t):
    return t.groupBy("h").agg(F.count("*").alias("n"))


@query("bilinear_sample", DEM, "SELECT a.x, a.y, round((CAST(d.h - e.h AS DOUBLE) * 0.25 + e.h - (CAST(b.h - a.h AS DOUBLE) * 0.25 + a.h)) * 0.5 + (CAST(b.h - a.h AS DOUBLE) * 0.25 + a.h), 6) AS h FROM t a LEFT JOIN t b ON b.x = a.x + 1 AND b.y = a.y LEFT JOIN t e ON e.x = a.x AND e.y = a.y + 1 LEFT JOIN t d ON d.x = a.x + 1 AND d.y = a.y + 1")
def _(t):
    n = raster.neighbourhood(t)
    return n.select("x", "y", F.round(terrain.bilinear(c("n4"), c("n5"), c("n7"), c("n8"), F.lit(0.25), F.lit(0.5)), 6).alias("h"))


@query("point_lookup", DEM, "SELECT x, y, CASE WHEN (x + y) % 9 = 0 THEN -1 ELSE h END AS h FROM t")
def _(t):
    new = t.where((c("x") + c("y")) % 9 == 0).select("x", "y", F.lit(-1).alias("h"))
    return raster.heights_at(raster.with_heights(t, new), t.select("x", "y")).select("x", "y", "h")


_DEG = f"(180.0 / {PI})"


@query("nearest_sample", DEM, f"--withp AS (SELECT x AS px, y AS py, CAST(round_even(x / 50000.0 * {_DEG} * 1200, 0) AS INT) AS x, CAST(round_even((2.0 * atan(exp(y / 50000.0)) - {PI} / 2) * {_DEG} * 1200, 0) AS INT) AS y FROM t) SELECT px, py, t.h FROM p LEFT JOIN t USING (x, y)")
def _(t):
    return raster.nearest_at(t, t.select(c("x").alias("px"), c("y").alias("py")), projections.Mercator(50000.0), 1200.0)


_DOWN = "w AS (SELECT tx, ty, h, least((tx + 1) / 0.4::DOUBLE, x + 1.0) - greatest(tx / 0.4::DOUBLE, x) AS wx, least((ty + 1) / 0.4::DOUBLE, y + 1.0) - greatest(ty / 0.4::DOUBLE, y) AS wy FROM (SELECT unnest(range(25)) AS tx) CROSS JOIN (SELECT unnest(range(25)) AS ty) JOIN {s} ON x < (tx + 1) / 0.4::DOUBLE AND x + 1 > tx / 0.4::DOUBLE AND y < (ty + 1) / 0.4::DOUBLE AND y + 1 > ty / 0.4::DOUBLE)"


@query("downsample_area_weighted", DEM, "--with" + _DOWN.format(s="t") + " SELECT CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, CAST(round_even(round(sum(h * wx * wy) / sum(CASE WHEN h IS NOT NULL THEN wx * wy END), 9), 0) AS INT) AS h FROM w WHERE wx > 0 AND wy > 0 GROUP BY tx, ty")
def _(t):
    return raster.downsample(t, 0.4, 64, 64)


@query("water_downsample", COVER, "--with" + _DOWN.format(s="t") + " SELECT CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, CASE WHEN round(sum(CASE WHEN h = 80 THEN wx * wy ELSE 0 END) / sum(wx * wy) * 1000000, 0) > 500000 THEN 1 ELSE 0 END AS h FROM w WHERE wx > 0 AND wy > 0 GROUP BY tx, ty")
def _(t):
    return water.downsample_water(t.withColumn("h", water.monochrome(c("h"))), 0.4, 64, 64)


_UP = "SELECT {l}CAST(floor(x / 2.0) AS INT) AS x, CAST(floor(y / 2.0) AS INT) AS y, CAST(round_even(avg(h), 0) AS INT) AS h FROM {s} GROUP BY floor(x / 2.0), floor(y / 2.0)"


@query("pyramid_level_up", DEM, _UP.format(l="", s="t"))
def _(t):
    return raster.level_up(t)


@query("pyramid_full", DEM, "--with" + ", ".join(f"l{k} AS (" + _UP.format(l="", s="t" if k == 1 else f"l{k - 1}") + ")" for k in range(1, 7)) + " " + " UNION ALL ".join(f"SELECT {k} AS level, x, y, h FROM l{k}" for k in range(1, 7)))
def _(t):
    return raster.pyramid(t)


@query("raster_pad_rim", DEM, "SELECT x, y, h FROM t UNION ALL SELECT 64, i, NULL FROM (SELECT CAST(unnest(range(65)) AS INT) AS i) UNION ALL SELECT i, 64, NULL FROM (SELECT CAST(unnest(range(64)) AS INT) AS i)")
def _(t):
    return raster.pad_rim(t, 0, 0, 64, 64)


@query("height_u16_encode", DEM, "SELECT x, y, coalesce((h + 32768) & 65535, 0) AS v FROM t")
def _(t):
    return t.select("x", "y", raster.encode_u16(c("h")).alias("v"))


@query("height_u16_decode", DEM, "SELECT x, y, h FROM t")
def _(t):
    return t.select("x", "y", raster.decode_u16(raster.encode_u16(c("h"))).alias("h"))


@query("encode_water_into_dem", DEM, "SELECT x, y, CASE WHEN h IS NULL THEN NULL WHEN (x + y) % 3 = 0 THEN (h + 500) - 32768 ELSE h + 500 END AS v FROM t")
def _(t):
    return t.select("x", "y", F.when(c("h").isNotNull(), raster.encode_water(c("h"), ((c("x") + c("y")) % 3 == 0).cast("int"))).alias("v"))


@query("raster_diff", DEM, "--withb AS (SELECT x + 1 AS x, y, CASE WHEN y % 4 = 0 THEN h ELSE 7 END AS h FROM t) SELECT coalesce(t.x, b.x) AS x, coalesce(t.y, b.y) AS y, t.h AS left_h, b.h AS right_h FROM t FULL JOIN b ON t.x = b.x AND t.y = b.y WHERE t.x IS NULL OR b.x IS NULL OR t.h IS DISTINCT FROM b.h")
def _(t):
    return raster.difference(t, t.select((c("x") + 1).alias("x"), "y", F.when(c("y") % 4 == 0, c("h")).otherwise(7).alias("h")))


@query("raster_union_mbr", PARTS, "SELECT min(x) AS min_x, min(y) AS min_y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM t")
def _(t):
    return raster.union_mbr(t.groupBy("src_ord").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height")))


@query("halfwidth_expand", DEM, "SELECT x * 2 + k AS x, y, h FROM t CROSS JOIN (VALUES (0), (1)) AS v(k)")
def _(t):
    return t.select(F.explode(F.array(c("x") * 2, c("x") * 2 + 1)).alias("x"), "y", "h")


_BYTES = "SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_partkey % 256 AS INT) AS b0, CAST(l_suppkey * 3 % 256 AS INT) AS b1 FROM lineitem"
_S16 = "nullif(CASE WHEN {v} > 32767 THEN {v} - 65536 ELSE {v} END, -32768)"


def s16(v):
    return F.nullif(F.when(v > 32767, v - 65536).otherwise(v), F.lit(-32768))


@query("decode_be16", _BYTES, f"SELECT id, {_S16.format(v='(b0 * 256 + b1)')} AS h FROM t")
def _(t):
    return t.select("id", s16(c("b0") * 256 + c("b1")).alias("h"))


@query("decode_le16", _BYTES, f"SELECT id, {_S16.format(v='(b1 * 256 + b0)')} AS h FROM t")
def _(t):
    return t.select("id", s16(c("b1") * 256 + c("b0")).alias("h"))


# --- projections -----------------------------------------------------------------------------------------------------

_RAD = f"(lon * {PI} / 180)", f"(lat * {PI} / 180)"


@query("mercator_forward", fx.POINTS, f"SELECT id, CASE WHEN abs({_RAD[1]}) <= 1.48442222974533 THEN round({_RAD[0]} * 2.0, 8) END AS px, CASE WHEN abs({_RAD[1]}) <= 1.48442222974533 THEN round(ln(tan({PI} / 4 + {_RAD[1]} / 2)) * 2.0, 8) END AS py FROM t")
def _(t):
    x, y = projections.Mercator(2.0).forward(angles.deg_to_rad(c("lon")), angles.deg_to_rad(c("lat")))
    return t.select("id", F.round(x, 8).alias("px"), F.round(y, 8).alias("py"))


@query("mercator_inverse", fx.POINTS, f"SELECT id, round(lon / 60.0, 8) AS lon_r, round(2.0 * atan(exp(lat / 60.0)) - {PI} / 2, 8) AS lat_r FROM t")
def _(t):
    x, y = projections.Mercator(60.0).inverse(c("lon"), c("lat"))
    return t.select("id", F.round(x, 8).alias("lon_r"), F.round(y, 8).alias("lat_r"))


LCC = projections.LambertConformalConic(25.0, 55.0)
_K = LCC.constants()
_LCC_R = f"({_K['a'] * _K['f']!r} * pow(tan(({PI} / 2 - {_RAD[1]}) * 0.5) / pow((1 - {_K['e']!r} * sin({_RAD[1]})) / (1 + {_K['e']!r} * sin({_RAD[1]})), {_K['e'] / 2!r}), {_K['n']!r}))"


_LCC_L = f"(CASE WHEN abs({_RAD[0]}) < {PI}::DOUBLE THEN {_RAD[0]} ELSE {_RAD[0]} - sign({_RAD[0]}) * 2 * {PI}::DOUBLE END)"


@query("lcc_forward", fx.POINTS, f"SELECT id, round({_LCC_R} * sin({_K['n']!r} * {_LCC_L}), 1) AS px, round({_K['rh']!r} - {_LCC_R} * cos({_K['n']!r} * {_LCC_L}), 1) AS py FROM t")
def _(t):
    x, y = LCC.forward(angles.deg_to_rad(c("lon")), angles.deg_to_rad(c("lat")))
    return t.select("id", F.round(x, 1).alias("px"), F.round(y, 1).alias("py"))


@query("lcc_inverse", fx.POINTS, "SELECT id, round(CASE WHEN lon <= -180 THEN lon + 360 ELSE lon END, 6) AS lon2, round(lat, 6) AS lat2 FROM t")
def _(t):
    x, y = LCC.forward(angles.deg_to_rad(c("lon")), angles.deg_to_rad(c("lat")))
    p = t.select("id", x.alias("px"), y.alias("py"))
    lon, lat = LCC.inverse(c("px"), c("py"))
    return p.select("id", F.round(angles.rad_to_deg(lon), 6).alias("lon2"), F.round(angles.rad_to_deg(lat), 6).alias("lat2"))


def hav_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(sin(({lat2} - {lat1}) / 2.0) * sin(({lat2} - {lat1}) / 2.0) + cos({lat1}) * cos({lat2}) * sin(({lon2} - {lon1}) / 2.0) * sin(({lon2} - {lon1}) / 2.0))"
    return f"(12742000.0::DOUBLE * atan2(sqrt({h}), sqrt(1.0 - {h})))"


@query("haversine_distance", fx.POINTS, f"SELECT id, round({hav_sql(*_RAD, '0.27', '0.81')}, 2) AS meters FROM t")
def _(t):
    return t.select("id", F.round(projections.haversine(angles.deg_to_rad(c("lon")), angles.deg_to_rad(c("lat")), F.lit(0.27), F.lit(0.81)), 2).alias("meters"))


_INV = "(2.0 * atan(exp(({v}) / 3000.0)) - {pi} / 2)"


@query("lonlat_delta", fx.POINTS, f"SELECT id, round(least(1.0 / 3000.0, abs({_INV.format(v='lat + 1', pi=PI)} - {_INV.format(v='lat', pi=PI)})), 9) AS delta FROM t")
def _(t):
    return t.select("id", F.round(projections.lon_lat_delta(projections.Mercator(3000.0), c("lon"), c("lat")), 9).alias("delta"))


@query("min_lonlat_delta", fx.POINTS, f"SELECT level, round(min(least(1.0 / 3000.0, abs({_INV.format(v='lat + 1', pi=PI)} - {_INV.format(v='lat', pi=PI)}))), 9) AS delta FROM t GROUP BY level")
def _(t):
    return t.groupBy("level").agg(F.round(F.min(projections.lon_lat_delta(projections.Mercator(3000.0), c("lon"), c("lat"))), 9).alias("delta"))


@query("dem_level_needed", fx.POINTS, "SELECT id, least(6, greatest(0, CAST(trunc(log2((lat + 80.001) / 200 * 3600)) AS INT))) AS dem_level FROM t")
def _(t):
    return t.select("id", projections.level_needed((c("lat") + 80.001) / 200, 3600).alias("dem_level"))


# --- terrain and shading ---------------------------------------------------------------------------------------------

_P = "(((h8 + 2.0 * h5 + h2) - (h6 + 2.0 * h3 + h0)) / (8.0 * w))"
_Q = "(((h8 + 2.0 * h7 + h6) - (h2 + 2.0 * h1 + h0)) / (8.0 * hgt))"
_SLOPE = f"atan(sqrt({_P} * {_P} + {_Q} * {_Q}))"
TWO_PI = "6.283185307179586::DOUBLE"
_ASPECT = norm_sql(f"4.71238898038469::DOUBLE - atan2({_Q}, {_P})", TWO_PI)
_SA = f"--withs AS (SELECT id, {_SLOPE} AS slope, {_ASPECT} AS aspect FROM t) "


def _slope_aspect(t: DataFrame) -> DataFrame:
    p, q = terrain.horn([c(f"h{k}") for k in range(9)], c("w"), c("hgt"))
    s, a = terrain.slope_aspect(c("p"), c("q"))
    return t.select("id", p.alias("p"), q.alias("q")).select("id", s.alias("slope"), a.alias("aspect"))


def igor_sql(slope: str, aspect: str) -> str:
    az = "(-0.7853981633974483::DOUBLE)"
    return byte_trunc(f"{slope} / 1.5707963267948966::DOUBLE * ({diff_sql(aspect, az, TWO_PI)} / {PI}::DOUBLE) * 1.0")


def lambert_sql(slope: str, aspect: str) -> str:
    light = f"{math.sin(math.pi / 4)!r}::DOUBLE * cos({slope}) + {math.cos(math.pi / 4)!r}::DOUBLE * sin({slope}) * cos({aspect} - (-0.7853981633974483::DOUBLE))"
    return byte_trunc(f"(1.0 - least(greatest({light}, 0.0), 1.0)) * 1.0")


def slope_sql(slope: str) -> str:
    return mixed("0::BIGINT", "255::BIGINT", f"{slope} * 180.0 / {PI}::DOUBLE / 90.0 * 1.0")


@query("horn_gradient", fx.STENCILS, f"SELECT id, round({_P}, 8) AS p, round({_Q}, 8) AS q FROM t")
def _(t):
    p, q = terrain.horn([c(f"h{k}") for k in range(9)], c("w"), c("hgt"))
    return t.select("id", F.round(p, 8).alias("p"), F.round(q, 8).alias("q"))


@query("slope_aspect", fx.STENCILS, _SA + "SELECT id, round(slope, 8) AS slope, round(aspect, 8) AS aspect FROM s")
def _(t):
    return _slope_aspect(t).select("id", F.round("slope", 8).alias("slope"), F.round("aspect", 8).alias("aspect"))


@query("shade_igor", fx.STENCILS, _SA + f"SELECT id, {igor_sql('slope', 'aspect')} AS rgba FROM s")
def _(t):
    return _slope_aspect(t).select("id", terrain.igor(c("slope"), c("aspect")).alias("rgba"))


@query("shade_lambert", fx.STENCILS, _SA + f"SELECT id, {lambert_sql('slope', 'aspect')} AS rgba FROM s")
def _(t):
    return _slope_aspect(t).select("id", terrain.lambert(c("slope"), c("aspect")).alias("rgba"))


@query("shade_slope", fx.STENCILS, _SA + f"SELECT id, {slope_sql('slope')} AS rgba FROM s")
def _(t):
    return _slope_aspect(t).select("id", terrain.slope_color(c("slope")).alias("rgba"))


_COMPASS = [f"{x}::BIGINT" for x in terrain.COMPASS]


@query("shade_aspect", fx.STENCILS, _SA + f", d AS (SELECT id, {norm_sql(f'aspect * 180.0 / {PI}::DOUBLE', '360.0::DOUBLE')} AS deg FROM s) SELECT id, CASE WHEN deg <= 90 THEN {mixed(_COMPASS[0], _COMPASS[1], '(deg - 0.0) / 90.0')} WHEN deg <= 180 THEN {mixed(_COMPASS[1], _COMPASS[2], '(deg - 90.0) / 90.0')} WHEN deg <= 270 THEN {mixed(_COMPASS[2], _COMPASS[3], '(deg - 180.0) / 90.0')} ELSE {mixed(_COMPASS[3], _COMPASS[0], '(deg - 270.0) / 90.0')} END AS rgba FROM d")
def _(t):
    return _slope_aspect(t).select("id", terrain.aspect_color(c("aspect")).alias("rgba"))


def elevation_sql(h: str) -> str:
    s = terrain.DEFAULT_SCALE
    out = f"CASE WHEN {h} IS NULL THEN 0 WHEN {h} <= {s[0][0]} THEN {s[0][1]} "
    for (h0, c0), (h1, c1) in zip(s, s[1:], strict=False):
        out += f"WHEN {h} <= {h1} THEN {mixed(f'{c0}::BIGINT', f'{c1}::BIGINT', f'({h} - {float(h0)}) / {float(h1 - h0)}::DOUBLE')} "
    return out + f"ELSE {s[-1][1]} END"


@query("elevation_color", DEM, f"SELECT x, y, {elevation_sql('h')} AS rgba FROM t")
def _(t):
    return t.select("x", "y", terrain.elevation_color(c("h")).alias("rgba"))


@query("shade_solid", DEM, "SELECT x, y, 4294967295 AS rgba FROM t")
def _(t):
    return shading.shaded(t.select("x", "y", c("h").alias("height"), F.lit(None).cast("double").alias("slope"), F.lit(None).cast("double").alias("aspect")), shading.Leaf("solid"))


def _dense(t: DataFrame) -> DataFrame:
    return raster.extract(t, 0, 0, 64, 64)


_PIX = (
    "--withd AS (SELECT CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y FROM (SELECT unnest(range(4096)) AS i)), f AS (SELECT d.x, d.y, t.h FROM d LEFT JOIN t USING (x, y)), "
    "b AS (SELECT a.x, a.y, (CAST(g.h - e.h AS DOUBLE) * 0.25 + e.h - (CAST(b.h - a.h AS DOUBLE) * 0.25 + a.h)) * 0.5 + (CAST(b.h - a.h AS DOUBLE) * 0.25 + a.h) AS h FROM f a LEFT JOIN f b ON b.x = a.x + 1 AND b.y = a.y LEFT JOIN f e ON e.x = a.x AND e.y = a.y + 1 LEFT JOIN f g ON g.x = a.x + 1 AND g.y = a.y + 1), "
    + _N9.format(s="b")
    + f", g AS (SELECT *, {hav_sql(*[f'(({o} + ({v} + {k}) / 1200.0::DOUBLE) * {float(PI) / 180!r}::DOUBLE)' for o, v, k in (('16.0::DOUBLE', 'x', -1), ('45.0::DOUBLE', 'y', -1), ('16.0::DOUBLE', 'x', 0), ('45.0::DOUBLE', 'y', -1))])} AS w, {hav_sql(*[f'(({o} + ({v} + {k}) / 1200.0::DOUBLE) * {float(PI) / 180!r}::DOUBLE)' for o, v, k in (('16.0::DOUBLE', 'x', -1), ('45.0::DOUBLE', 'y', -1), ('16.0::DOUBLE', 'x', -1), ('45.0::DOUBLE', 'y', 0))])} AS hgt FROM n), "
    + f"s AS (SELECT x, y, h AS height, {_SLOPE} AS slope, {_ASPECT} AS aspect FROM g)".replace("h8", "n8").replace("h7", "n7").replace("h6", "n6").replace("h5", "n5").replace("h3", "n3").replace("h2", "n2").replace("h1", "n1").replace("h0", "n0")
)


def _pixels(t: DataFrame) -> DataFrame:
    return shading.terrain_pixels(_dense(t), 16.0, 45.0, 1200.0)


@query("slope_aspect_grid", DEM, _PIX + " SELECT x, y, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM s")
def _(t):
    return _pixels(t).select("x", "y", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


_NZ = "CASE WHEN slope IS NULL THEN 0 ELSE {e} END"


@query("shade_pipeline_default", DEM, _PIX + f", p AS (SELECT x, y, {elevation_sql('height')} AS e, {_NZ.format(e=igor_sql('slope', 'aspect'))} AS i FROM s) SELECT x, y, {over_sql('i', 'e')} AS rgba FROM p")
def _(t):
    return shading.shaded(_pixels(t), shading.DEFAULT)


@query("shade_pipeline_tile", DEM, _PIX + f", p AS (SELECT x, y, {_NZ.format(e=lambert_sql('slope', 'aspect'))} AS l, {_NZ.format(e=slope_sql('slope'))} AS sl, {_NZ.format(e=igor_sql('slope', 'aspect'))} AS i FROM s), q AS (SELECT x, y, i, {darken_sql('l', 'sl')} AS d FROM p), r AS (SELECT x, y, {darken_sql('i', 'd')} AS d2, 4294967295::BIGINT AS w FROM q) SELECT x, y, {over_sql('d2', 'w')} AS rgba FROM r")
def _(t):
    return shading.shaded(_pixels(t), shading.TILE)


@query("custom_shader", DEM, _PIX + " SELECT x, y, CASE WHEN height > 1000 THEN 4278190335 ELSE 65535 END AS rgba FROM s")
def _(t):
    shading.register_shader("high", lambda height, slope, aspect: F.when(height > 1000, color.literal(255, 0, 0)).otherwise(color.literal(0, 0, 255)).cast("long"))
    return shading.shaded(_pixels(t), shading.Leaf("high"))


# --- water -----------------------------------------------------------------------------------------------------------


@query("water_monochrome", COVER, "SELECT x, y, CASE WHEN h = 80 THEN 1 ELSE 0 END AS h FROM t")
def _(t):
    return t.withColumn("h", water.monochrome(c("h")))


_FLOOD = f"WITH RECURSIVE t AS ({COVER}), w AS (SELECT x, y, y * 64 + x AS cell FROM t WHERE h = 80), r(cell, root) AS (SELECT cell, cell FROM w UNION SELECT b.y * 64 + b.x, r.root FROM r JOIN w b ON b.cell IN (r.cell - 1, r.cell + 1, r.cell - 64, r.cell + 64) AND abs(b.x - r.cell % 64) + abs(b.y - r.cell // 64) = 1 WHERE r.root < b.cell), m AS (SELECT cell, min(root) AS root FROM r GROUP BY cell), k AS (SELECT cell, CAST(dense_rank() OVER (ORDER BY root) + 1 AS INT) AS color FROM m), z AS (SELECT w.x, w.y, k.color FROM w JOIN k USING (cell))"


def _water(t: DataFrame) -> DataFrame:
    return water.components(t.withColumn("h", water.monochrome(c("h"))), 64)


@query("water_components", COVER)
def _(t):
    return _water(t)


@query("water_component_stats", COVER)
def _(t):
    return water.component_stats(_water(t))


ORACLE_SQL["water_components"] = _FLOOD + " SELECT x, y, color FROM z"
ORACLE_SQL["water_component_stats"] = _FLOOD + " SELECT color, count(*) AS surface_area, min(x) AS min_x, min(y) AS min_y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM z GROUP BY color"


@query("water_outline_distance", COVER, "--withd AS (SELECT CAST(i % 66 - 1 AS INT) AS x, CAST(i // 66 - 1 AS INT) AS y FROM (SELECT unnest(range(66 * 66)) AS i)), l AS (SELECT d.x, d.y FROM d LEFT JOIN t USING (x, y) WHERE t.h IS DISTINCT FROM 80) SELECT t.x, t.y, CAST(min(abs(t.x - l.x) + abs(t.y - l.y)) AS INT) AS dist FROM t, l WHERE t.h = 80 GROUP BY t.x, t.y")
def _(t):
    return water.distance_to_shore(raster.extract(t, 0, 0, 64, 64).withColumn("h", F.coalesce(water.monochrome(c("h")), F.lit(0))))


@query("water_body_filter", "SELECT o_orderkey AS id, o_orderkey % 5000 + 1 AS area, o_custkey % 200 + 1 AS w, o_orderkey % 170 + 1 AS hh FROM orders", "SELECT id, area >= 1250 AND (w * hh) // area < 10 AS shown FROM t")
def _(t):
    return t.select("id", water.shown(c("area"), c("w"), c("hh")).alias("shown"))


@query("shade_water_from_dem", DEM, "SELECT x, y, CASE WHEN h % 2 = 1 THEN 1237909503 ELSE 0 END AS rgba FROM t")
def _(t):
    return t.select("x", "y", water.flag_color(c("h")).alias("rgba"))


@query("split_3x3_tiles", DEM, "SELECT CAST(floor(x / 22.0) AS INT) AS tile_x, CAST(floor(y / 22.0) AS INT) AS tile_y, count(*) AS cells, CAST(sum(h) AS BIGINT) AS total FROM t GROUP BY 1, 2")
def _(t):
    return tiles.tile_parts(t, 22).groupBy("tile_x", "tile_y").agg(F.count("*").alias("cells"), F.sum("h").alias("total"))


# --- geometry --------------------------------------------------------------------------------------------------------

def points() -> list[geometry.Point]:
    return [(c(f"x{k}"), c(f"y{k}")) for k in range(1, 5)]


@query("orientation", fx.SEGMENTS, "SELECT id, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS area, CASE WHEN abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) <= 0.0001 THEN 'collinear' WHEN (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) > 0 THEN 'left' ELSE 'right' END AS side FROM t")
def _(t):
    a = geometry.area2(*points()[:3])
    return t.select("id", a.alias("area"), geometry.side(a, 1e-4).alias("side"))


@query("segment_midpoint_length", fx.SEGMENTS, "SELECT id, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 9) AS length FROM t")
def _(t):
    a, b = points()[:2]
    mx, my = geometry.midpoint(a, b)
    return t.select("id", mx.alias("mx"), my.alias("my"), F.round(geometry.length(a, b), 9).alias("length"))


@query("segment_kind_extend", fx.SEGMENTS, "--withl AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS n FROM t) SELECT id, CASE WHEN x1 = x2 AND y1 = y2 THEN 'point' WHEN y1 = y2 THEN 'horizontal' WHEN x1 = x2 THEN 'vertical' ELSE 'sloped' END AS kind, round(x1 - CASE WHEN n > 0 THEN (x2 - x1) / n ELSE 0 END * 2, 9) AS ax, round(y2 + CASE WHEN n > 0 THEN (y2 - y1) / n ELSE 0 END * 3, 9) AS by FROM l")
def _(t):
    p, q = points()[:2]
    a, b = geometry.extended(p, q, 2.0, 3.0)
    return t.select("id", geometry.segment_kind(p, q).alias("kind"), F.round(a[0], 9).alias("ax"), F.round(b[1], 9).alias("by"))


def _a2(a: int, b: int, d: int) -> str:
    return f"((x{b} - x{a}) * (y{d} - y{a}) - (x{d} - x{a}) * (y{b} - y{a}))"


def _btw(a: int, b: int, d: int, s: str) -> str:
    v = lambda z: f"(({z}{a} <= {z}{d} AND {z}{d} <= {z}{b}) OR ({z}{a} >= {z}{d} AND {z}{d} >= {z}{b}))"
    return f"({s} = 0 AND CASE WHEN x{a} <> x{b} THEN {v('x')} ELSE {v('y')} END)"


_SG = "--withs AS (SELECT *, " + ", ".join(f"CASE WHEN abs({_a2(a, b, d)}) <= 0.0001 THEN 0 WHEN {_a2(a, b, d)} > 0 THEN 1 ELSE -1 END AS s{d}" for a, b, d in ((1, 2, 3), (1, 2, 4), (3, 4, 1), (3, 4, 2))) + " FROM t), o AS (SELECT *, " + ", ".join(f"{_btw(a, b, d, f's{d}')} AS on{d}" for a, b, d in ((1, 2, 3), (1, 2, 4), (3, 4, 1), (3, 4, 2))) + " FROM s), m AS (SELECT *, " + ", ".join(f"CASE WHEN NOT on{a} AND NOT on{b} THEN 0 WHEN (on{a} AND on{b}) OR (on{a} AND s{b} = 0) OR (on{b} AND s{a} = 0) THEN 2 ELSE 1 END AS m{a}{b}" for a, b in ((3, 4), (1, 2))) + " FROM o) SELECT id, CASE WHEN (x1 = x2 AND y1 = y2) OR (x3 = x4 AND y3 = y4) THEN 'OneOrBothAreZeroLength' WHEN x1 = x3 AND y1 = y3 AND x2 = x4 AND y2 = y4 THEN 'Same' WHEN x1 = x4 AND y1 = y4 AND x2 = x3 AND y2 = y3 THEN 'Opposite' WHEN (x1 = x3 AND y1 = y3) OR (x2 = x4 AND y2 = y4) OR (x1 = x4 AND y1 = y4) OR (x2 = x3 AND y2 = y3) THEN 'SharingOneEndpoint' WHEN s1 <> 0 AND s2 <> 0 AND s3 <> 0 AND s4 <> 0 AND s3 <> s4 AND s1 <> s2 THEN 'IntersectProperly' WHEN m34 = 2 OR m12 = 2 THEN 'CollinearOverlapping' WHEN m34 = 1 AND m12 = 1 THEN 'SharingOneEndpoint' WHEN m34 = 1 OR m12 = 1 THEN 'OneEndpointLiesOnOtherSegment' ELSE 'NotIntersect' END AS kind FROM m"


@query("segments_intersect_class", fx.SEGMENTS, _SG)
def _(t):
    return t.select("id", geometry.intersection_class(*points()).alias("kind"))


_ST = "--withn AS (SELECT *, x1 * (y4 - y3) + x2 * (y3 - y4) + x4 * (y2 - y1) + x3 * (y1 - y2) AS dn FROM t), u AS (SELECT *, (x1 * (y4 - y3) + x3 * (y1 - y4) + x4 * (y3 - y1)) / nullif(dn, 0) AS sv, -(x1 * (y3 - y2) + x2 * (y1 - y3) + x3 * (y2 - y1)) / nullif(dn, 0) AS tv FROM n) SELECT id, round(x1 + sv * (x2 - x1), 6) AS px, round(y1 + sv * (y2 - y1), 6) AS py FROM u WHERE abs(dn) > 0.0001 AND sv >= -0.0001 AND sv <= 1.0001 AND tv >= -0.0001 AND tv <= 1.0001 AND NOT (x1 = x2 AND y1 = y2) AND NOT (x3 = x4 AND y3 = y4)"


@query("segments_intersection_point", fx.SEGMENTS, _ST)
def _(t):
    kind, x, y = geometry.intersection_point(*points())
    denom = c("x1") * (c("y4") - c("y3")) + c("x2") * (c("y3") - c("y4")) + c("x4") * (c("y2") - c("y1")) + c("x3") * (c("y1") - c("y2"))
    return t.where(F.abs(denom) > 1e-4).select("id", kind.alias("kind"), F.round(x, 6).alias("px"), F.round(y, 6).alias("py")).where("px is not null").drop("kind")


_EDGES = "--withv AS (SELECT id, ord, x AS x1, y AS y1, coalesce(lead(x) OVER (PARTITION BY id ORDER BY ord), first_value(x) OVER (PARTITION BY id ORDER BY ord)) AS x2, coalesce(lead(y) OVER (PARTITION BY id ORDER BY ord), first_value(y) OVER (PARTITION BY id ORDER BY ord)) AS y2 FROM t), e AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS INT) AS edge, x1, y1, x2, y2 FROM v WHERE x1 <> x2 OR y1 <> y2)"


@query("polygon_edges", fx.VERTICES, _EDGES + " SELECT * FROM e")
def _(t):
    return geometry.polygon_edges(t)


_CROSS = ", n AS (SELECT id, count(*) AS edges FROM e GROUP BY id), pr AS (SELECT a.id, a.x1, a.y1, a.x2, a.y2, b.x1 AS x3, b.y1 AS y3, b.x2 AS x4, b.y2 AS y4 FROM e a JOIN e b USING (id) JOIN n USING (id) WHERE a.edge + 1 < b.edge AND NOT (a.edge = 0 AND b.edge = edges - 1)), " + _SG.replace("--with", "").replace("FROM t)", "FROM pr)").replace(") SELECT id, CASE", "), kd AS (SELECT id, CASE")


@query("polygon_self_intersect", fx.VERTICES, _EDGES + _CROSS + "), z AS (SELECT id, count(*) AS crossings FROM kd WHERE kind <> 'NotIntersect' GROUP BY id) SELECT id, edges, coalesce(crossings, 0) AS crossings FROM n LEFT JOIN z USING (id)")
def _(t):
    return geometry.self_intersecting(t)


@query("triangle_normal", fx.SEGMENTS, "--withn AS (SELECT id, (y2 - y1) * (x4 - y3) - (x3 - x2) * (x3 - x1) AS nx, (x3 - x2) * (y1 - x1) - (x2 - x1) * (x4 - y3) AS ny, (x2 - x1) * (x3 - x1) - (y2 - y1) * (y1 - x1) AS nz FROM (SELECT id, x1, y1, y3, x2, y2, x3, x4 FROM t)) SELECT id, round(nx / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 8) AS nx, round(ny / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 8) AS ny, round(nz / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 8) AS nz FROM n")
def _(t):
    z = F.lit(0.0)
    n = geometry.triangle_normal([z, z, z], [c("x2") - c("x1"), c("y2") - c("y1"), c("x3") - c("x2")], [c("y1") - c("x1"), c("x3") - c("x1"), c("x4") - c("y3")])
    return t.select("id", *[F.round(v, 8).alias(k) for v, k in zip(n, ("nx", "ny", "nz"), strict=True)])


# --- contours --------------------------------------------------------------------------------------------------------

_CE = "--withe AS (SELECT 'h' AS axis, a.x, a.y, CASE WHEN a.h <= 500 AND b.h > 500 THEN 'right' WHEN a.h > 500 AND b.h <= 500 THEN 'left' END AS dir FROM t a JOIN t b ON b.x = a.x AND b.y = a.y + 1 UNION ALL SELECT 'v', a.x, a.y, CASE WHEN a.h <= 500 AND b.h > 500 THEN 'up' WHEN a.h > 500 AND b.h <= 500 THEN 'down' END FROM t a JOIN t b ON b.y = a.y AND b.x = a.x + 1), g AS (SELECT * FROM e WHERE dir IS NOT NULL)"


@query("contour_edges", DEM, _CE + " SELECT axis, x, y, dir FROM g")
def _(t):
    return contours.contour_edges(t, 500)


@query("isoline_edge_count", DEM, _CE + " SELECT axis, dir, count(*) AS n FROM g GROUP BY axis, dir")
def _(t):
    return contours.contour_edges(t, 500).groupBy("axis", "dir").agg(F.count("*").alias("n"))


_RULES = ", ".join(f"('{a}', '{d}', {k}, '{na}', '{nd}', {dx}, {dy})" for a, d, ways in contours.NEXT for k, (na, nd, dx, dy) in enumerate(ways))


@query("isoline_next_step", DEM, _CE + f", r(axis, dir, rank, na, nd, dx, dy) AS (VALUES {_RULES}), j AS (SELECT g.axis, g.x, g.y, g.dir, r.rank, n.axis AS next_axis, n.x AS next_x, n.y AS next_y, n.dir AS next_dir, row_number() OVER (PARTITION BY g.axis, g.x, g.y, g.dir ORDER BY r.rank) AS k FROM g JOIN r USING (axis, dir) JOIN g n ON n.axis = r.na AND n.dir = r.nd AND n.x = g.x + r.dx AND n.y = g.y + r.dy) SELECT g.axis, g.x, g.y, g.dir, next_axis, next_x, next_y, next_dir FROM g LEFT JOIN j ON j.k = 1 AND j.axis = g.axis AND j.x = g.x AND j.y = g.y AND j.dir = g.dir")
def _(t):
    return contours.next_steps(contours.contour_edges(t, 500))


@query("isolines", DEM)
def _(t):
    return contours.isolines(t, 500)


_RUNS = "--withi AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) - row_number() OVER (PARTITION BY id, dir ORDER BY ord) AS island FROM t), q AS (SELECT id, dir, count(*) AS cnt, min(ord) AS f FROM i GROUP BY id, dir, island), m AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY f) AS INT) AS run, dir, cnt FROM q)"


@query("steps_to_moves", fx.MOVES, _RUNS + " SELECT * FROM m")
def _(t):
    return contours.runs(t)


@query("moves_to_steps", fx.MOVES, "SELECT id, CAST(ord AS INT) AS step, CAST(sum(CASE dir WHEN 'N' THEN 0 WHEN 'E' THEN 1 ELSE -1 END) OVER w AS BIGINT) AS x, CAST(sum(CASE dir WHEN 'E' THEN 0 WHEN 'SW' THEN 1 ELSE -1 END) OVER w AS BIGINT) AS y FROM t WINDOW w AS (PARTITION BY id ORDER BY ord)")
def _(t):
    return contours.walk(contours.runs(t))


# --- ordered collections ---------------------------------------------------------------------------------------------


@query("ordered_items", "SELECT o_custkey AS k FROM orders", "SELECT k, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS pos FROM t")
def _(t):
    # counts by key first: the one ordered pass is over distinct keys, and positions are given back within each key
    n = t.groupBy("k").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return before.select("k", F.explode(F.sequence(c("before") + 1, c("before") + c("n"))).alias("pos"))


@query("multiset_remove_one", "SELECT o_custkey AS k FROM orders", "SELECT k, count(*) - CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n FROM t GROUP BY k HAVING count(*) - CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END > 0")
def _(t):
    gone = t.where("k % 2 = 0").distinct()
    return t.exceptAll(gone).groupBy("k").agg(F.count("*").alias("n"))


@query("contains_semi", "SELECT c_custkey AS k, c_custkey * 3 % 1000 AS probe FROM customer", "SELECT probe, probe IN (SELECT k FROM t WHERE k % 2 = 0) AS found FROM t")
def _(t):
    have = t.where("k % 2 = 0").select(c("k").alias("have"))
    return t.join(have, c("probe") == c("have"), "left").select("probe", c("have").isNotNull().alias("found"))


@query("array_insert_remove", "SELECT p_partkey AS id, p_size AS s FROM part", "SELECT id, CAST(id AS VARCHAR) || ',' || s || ',-1,' || (s + 1) AS inserted, CAST(id AS VARCHAR) || ',' || (s + 1) AS removed FROM t")
def _(t):
    items = F.array(c("id").cast("string"), c("s").cast("string"), (c("s") + 1).cast("string"))
    return t.select("id", F.array_join(F.array_insert(items, 3, F.lit("-1")), ",").alias("inserted"), F.array_join(F.concat(F.slice(items, 1, 1), F.slice(items, 3, 1)), ",").alias("removed"))


# --- validation ------------------------------------------------------------------------------------------------------


_BTEXT = "SELECT o_orderkey AS id, CAST(CAST(o_custkey % 420 AS INT) - 200 AS VARCHAR(9)) || ',' || CAST(CAST(o_orderkey % 210 AS INT) - 100 AS VARCHAR(9)) || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ',' || CAST(CAST(o_custkey % 420 AS INT) - 190 AS VARCHAR(9)) || '.5,' || CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(CAST(o_custkey % 190 AS INT) - 95 AS VARCHAR(9)) END END AS txt FROM orders"


@query("bounds_validate", _BTEXT, f"--withs AS (SELECT id, txt, string_split(txt, ',') AS p FROM t), v AS (SELECT id, p, TRY_CAST(p[1] AS DOUBLE) AS a, TRY_CAST(p[2] AS DOUBLE) AS b, TRY_CAST(p[3] AS DOUBLE) AS d, TRY_CAST(p[4] AS DOUBLE) AS e FROM s) SELECT id, CASE WHEN len(p) <> 4 THEN '{parse.NOT_FOUR}' WHEN a IS NULL OR b IS NULL OR d IS NULL OR e IS NULL THEN '{parse.NOT_NUMBERS}' WHEN a NOT BETWEEN -179 AND 180 OR d NOT BETWEEN -179 AND 180 THEN '{parse.LON_RANGE}' WHEN b NOT BETWEEN -90 AND 90 OR e NOT BETWEEN -90 AND 90 THEN '{parse.LAT_RANGE}' WHEN a > d THEN '{parse.LON_ORDER}' WHEN b > e THEN '{parse.LAT_ORDER}' ELSE 'ok' END AS verdict FROM v")
def _(t):
    return t.select("id", F.coalesce(parse.bounds(c("txt"))[1], F.lit("ok")).alias("verdict"))


@query("tile_id_parse", "SELECT o_orderkey AS id, 'l' || CAST(CAST(o_orderkey % 7 AS INT) AS VARCHAR(9)) || CASE WHEN o_custkey % 2 = 0 THEN 'e' ELSE 'w' END || CAST(CAST(o_custkey % 90 AS INT) AS VARCHAR(9)) || CASE WHEN o_orderkey % 5 = 0 THEN 'x' WHEN o_orderkey % 3 = 0 THEN 's' ELSE 'n' END || CAST(CAST(o_orderkey % 60 AS INT) AS VARCHAR(9)) AS txt FROM orders", "SELECT id, CASE WHEN id % 5 <> 0 THEN CAST(regexp_extract(txt, '^l([0-9]+)', 1) AS INT) END AS level, CASE WHEN id % 5 <> 0 THEN CAST(regexp_extract(txt, '[ew]([0-9]+)', 1) AS INT) * CASE WHEN txt LIKE '%w%' THEN -1 ELSE 1 END END AS tile_x, CASE WHEN id % 5 <> 0 THEN CAST(regexp_extract(txt, '[ns]([0-9]+)', 1) AS INT) * CASE WHEN txt LIKE '%s%' THEN -1 ELSE 1 END END AS tile_y FROM t")
def _(t):
    return t.select("id", *[v.alias(n) for v, n in zip(parse.tile_id(c("txt")), ("level", "tile_x", "tile_y"), strict=True)])


@query("coverage_parse", _BTEXT, "--withs AS (SELECT id, string_split(txt, ',') AS p FROM t), v AS (SELECT id, p, [TRY_CAST(x AS DOUBLE) FOR x IN p] AS f FROM s) SELECT id, CAST(k AS INT) AS k, f[2 * k + 1] AS lon, f[2 * k + 2] AS lat FROM v CROSS JOIN LATERAL (SELECT unnest(range(len(p) // 2)) AS k) WHERE len(p) % 2 = 0 AND len([1 FOR x IN f IF x IS NULL]) = 0")
def _(t):
    return t.select("id", F.posexplode(parse.coverage(c("txt")))).select("id", c("pos").alias("k"), c("col.lon").alias("lon"), c("col.lat").alias("lat"))


@query("number_prefix", "SELECT p_partkey AS id, CAST(p_size AS VARCHAR(9)) || '.25' || p_brand AS txt FROM part", "SELECT id, CAST(regexp_extract(txt, '^[0-9]+\\.[0-9]+', 0) AS DOUBLE) AS f, CAST(regexp_extract(txt, '^[0-9]+', 0) AS INT) AS i FROM t")
def _(t):
    return t.select("id", parse.float_prefix(c("txt")).alias("f"), parse.int_prefix(c("txt")).alias("i"))


@query("validate_accumulate", fx.BOUNDS, "SELECT id, concat_ws(',', CASE WHEN min_lon < -100 THEN 'west' END, CASE WHEN min_lat < -40 THEN 'south' END, CASE WHEN max_lon <= min_lon THEN 'empty' END) AS errors FROM t")
def _(t):
    found = parse.collect_errors((c("min_lon") < -100, "west"), (c("min_lat") < -40, "south"), (c("max_lon") <= c("min_lon"), "empty"))
    return t.select("id", F.array_join(found, ",").alias("errors"))


# --- formats and texts -----------------------------------------------------------------------------------------------

for _how in grids.FORMATS:

    def _roundtrip(t: DataFrame, how: str = _how) -> DataFrame:
        cells = t.withColumn("h", F.when(c("h") > 1000, 1).otherwise(0)) if how == "png1" else t
        return grids.from_tiles(grids.to_tiles(cells, 32, how), 32, how).join(t.select("x", "y"), ["x", "y"], "left_semi")

    query(f"{_how}_roundtrip", DEM, "SELECT x, y, CASE WHEN h > 1000 THEN 1 ELSE 0 END AS h FROM t" if _how == "png1" else "SELECT x, y, h FROM t")(_roundtrip)


@query("paeth", fx.STENCILS, "SELECT id, CASE WHEN abs(h0 + h1 - h2 - h0) <= abs(h0 + h1 - h2 - h1) AND abs(h0 + h1 - h2 - h0) <= abs(h0 + h1 - h2 - h2) THEN h0 WHEN abs(h0 + h1 - h2 - h1) <= abs(h0 + h1 - h2 - h2) THEN h1 ELSE h2 END AS p FROM t")
def _(t):
    p = c("h0") + c("h1") - c("h2")
    a, b, d = F.abs(p - c("h0")), F.abs(p - c("h1")), F.abs(p - c("h2"))
    return t.select("id", F.when((a <= b) & (a <= d), c("h0")).when(b <= d, c("h1")).otherwise(c("h2")).alias("p"))


_KINDS = ("raw", "raw - lft", "raw - up", "raw - (lft + up) // 2")


@query("png_best_filter", COVER, "--withb AS (SELECT x, y, h AS raw, coalesce(lag(h) OVER (PARTITION BY y ORDER BY x), 0) AS lft, coalesce(lag(h) OVER (PARTITION BY x ORDER BY y), 0) AS up FROM t), s AS (SELECT y, " + ", ".join(f"sum(({k}) & 255) AS s{i}" for i, k in enumerate(_KINDS)) + " FROM b GROUP BY y) SELECT y, CASE WHEN s0 <= least(s1, s2, s3) THEN 0 WHEN s1 <= least(s2, s3) THEN 1 WHEN s2 <= s3 THEN 2 ELSE 3 END AS kind FROM s")
def _(t):
    left = F.coalesce(F.lag("h").over(Window.partitionBy("y").orderBy("x")), F.lit(0))
    up = F.coalesce(F.lag("h").over(Window.partitionBy("x").orderBy("y")), F.lit(0))
    b = t.withColumn("l", left).withColumn("u", up)
    kinds = [c("h"), c("h") - c("l"), c("h") - c("u"), c("h") - F.floor((c("l") + c("u")) / 2).cast("int")]
    s = b.groupBy("y").agg(*[F.sum(k.bitwiseAND(F.lit(255))).alias(f"s{i}") for i, k in enumerate(kinds)])
    return s.select("y", F.array_min(F.array(*[F.struct(c(f"s{i}").alias("s"), F.lit(i).alias("i")) for i in range(4)]))["i"].alias("kind"))


@query("png_scanline_length", "SELECT p_partkey AS id, p_size AS width, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 32 END AS bpp FROM part", "SELECT id, (width * bpp + 7) // 8 AS length FROM t")
def _(t):
    return t.select("id", F.ceil(c("width") * c("bpp") / 8).cast("int").alias("length"))


@query("crc32_text", "SELECT p_partkey AS id, p_name AS name FROM part")
def _(t):
    return t.select("id", F.crc32(c("name").cast("binary")).alias("crc"))


@query("parse_float_list", "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) || ',' || CAST(o_orderkey % 7 AS VARCHAR(20)) || '.5,' || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '-2' END AS txt FROM orders", "SELECT id, CASE WHEN id % 3 <> 0 THEN CAST(split_part(txt, ',', 1) AS DOUBLE) + CAST(split_part(txt, ',', 2) AS DOUBLE) - 2 END AS total FROM t")
def _(t):
    return t.select("id", F.aggregate(parse.floats(c("txt")), F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("proj_params", "SELECT p_partkey AS id, '+proj=lcc +lat_1=' || CAST(p_size AS VARCHAR(9)) || ' +lon_0=' || CAST(p_partkey % 90 AS VARCHAR(9)) AS txt FROM part", "SELECT id, 'lcc' AS proj, CAST(regexp_extract(txt, 'lat_1=([0-9]+)', 1) AS DOUBLE) AS lat_1, CAST(regexp_extract(txt, 'lon_0=([0-9]+)', 1) AS DOUBLE) AS lon_0 FROM t")
def _(t):
    m = F.str_to_map("txt", F.lit(" "), F.lit("="))
    return t.select("id", m["+proj"].alias("proj"), m["+lat_1"].cast("double").alias("lat_1"), m["+lon_0"].cast("double").alias("lon_0"))


@query("color_scale_string", "SELECT p_size AS h, max(p_partkey) * 7919 % 16777216 AS rgb, p_brand AS brand FROM part GROUP BY p_size, p_brand", "SELECT brand, string_agg(h || ':#' || lpad(lower(to_hex(rgb)), 6, '0'), ';' ORDER BY h) AS scale FROM t GROUP BY brand")
def _(t):
    mark = F.format_string("%d:#%06x", c("h"), c("rgb"))
    marks = F.array_sort(F.collect_list(F.struct("h", mark.alias("mark"))))
    return t.groupBy("brand").agg(F.array_join(F.transform(marks, lambda v: v["mark"]), ";").alias("scale"))


@query("svg_path_string", fx.VERTICES, "--withn AS (SELECT id, ord, x - 500.25 AS x, y / 4 AS y FROM t), p AS (SELECT id, ord, CAST(round(abs(x) * 100, 0) AS BIGINT) AS a, CAST(round(abs(y) * 100, 0) AS BIGINT) AS b, x < 0 AS neg FROM n), f AS (SELECT id, ord, CASE WHEN neg AND a > 0 THEN '-' ELSE '' END || (a // 100) || CASE WHEN a % 100 = 0 THEN '' ELSE '.' || regexp_replace(lpad(CAST(a % 100 AS VARCHAR), 2, '0'), '0$', '') END AS sx, ' ' || (b // 100) || CASE WHEN b % 100 = 0 THEN '' ELSE '.' || regexp_replace(lpad(CAST(b % 100 AS VARCHAR), 2, '0'), '0$', '') END AS sy FROM p) SELECT id, string_agg(CASE WHEN ord = 1 THEN 'M' ELSE 'L' END || sx || sy, '' ORDER BY ord) || 'Z' AS path FROM f GROUP BY id")
def _(t):
    step = F.struct("ord", F.when(c("ord") == 1, "M").otherwise("L").alias("letter"), F.array(c("x") - 500.25, c("y") / 4).alias("numbers"))
    steps = F.array_sort(F.collect_list(step))
    letters = F.concat(F.transform("s", lambda v: v["letter"]), F.array(F.lit("Z")))
    numbers = F.concat(F.transform("s", lambda v: v["numbers"]), F.array(F.array().cast("array<double>")))
    return t.groupBy("id").agg(steps.alias("s")).select("id", parse.svg_path_data(letters, numbers).alias("path"))


@query("tiff_tile_prune", "SELECT o_orderkey AS id, CAST(o_custkey * 37 % 36000 AS INT) AS x0, CAST(o_orderkey * 41 % 36000 AS INT) AS y0 FROM orders", "SELECT id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM t CROSS JOIN LATERAL (SELECT unnest(generate_series(x0 // 1024, least(x0 + 1500, 35999) // 1024)) AS tx) CROSS JOIN LATERAL (SELECT unnest(generate_series(y0 // 1024, least(y0 + 1500, 35999) // 1024)) AS ty)")
def _(t):
    (x0, x1), (y0, y1) = (tiles.block_range(c(v), F.lit(1500), 1024, 36000) for v in ("x0", "y0"))
    return tiles.explode_grid(t, x0, x1, y0, y1).select("id", c("tile_x").alias("tx"), c("tile_y").alias("ty"))


@query("geo_area_mbr", fx.POINTS, f"SELECT id, round((lon - 2) / 60.0, 8) AS min_lon, round(2.0 * atan(exp((lat - 1) / 60.0)) - {PI} / 2, 8) AS min_lat, round((lon + 2) / 60.0, 8) AS max_lon, round(2.0 * atan(exp((lat + 1) / 60.0)) - {PI} / 2, 8) AS max_lat FROM t")
def _(t):
    rects = t.select("id", (c("lon") - 2).alias("min_x"), (c("lat") - 1).alias("min_y"), (c("lon") + 2).alias("max_x"), (c("lat") + 1).alias("max_y"))
    return projections.geo_mbr(rects, projections.Mercator(60.0), "id").select("id", *[F.round(n, 8).alias(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("anneal_schedule", "SELECT event_id, event_id % 100 AS step, value AS delta FROM events", "SELECT event_id, round(100 * pow(0.85, step), 9) AS temperature, round(CASE WHEN delta <= 0 THEN 1.0 ELSE exp(-delta / (100 * pow(0.85, step))) END, 9) AS acceptance FROM t")
def _(t):
    temperature = F.lit(100.0) * F.pow(F.lit(0.85), c("step"))
    return t.select("event_id", F.round(temperature, 9).alias("temperature"), F.round(F.when(c("delta") <= 0, 1.0).otherwise(F.exp(-c("delta") / temperature)), 9).alias("acceptance"))


@query("dem_with_water", f"SELECT d.x, d.y, d.h, k.h AS cover FROM ({DEM}) d LEFT JOIN ({COVER}) k ON d.x = k.x AND d.y = k.y")
def _(t):
    return water.dem_with_water(t.select("x", "y", "h"), t.select("x", "y", c("cover").alias("h")).where("h is not null"), 64)


@query("shade_water", COVER)
def _(t):
    return water.body_color(t, 64)


_SHOWN = ", big AS (SELECT color FROM z GROUP BY color HAVING count(*) >= 1250 AND ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) // count(*) < 10), wet AS (SELECT x, y FROM z JOIN big USING (color))"
ORACLE_SQL["shade_water"] = _FLOOD + _SHOWN + " SELECT t.x, t.y, CASE WHEN wet.x IS NOT NULL THEN 1237909503 ELSE 0 END AS rgba FROM t LEFT JOIN wet USING (x, y)"
ORACLE_SQL["dem_with_water"] = _FLOOD + _SHOWN + f", dem AS ({DEM}) SELECT dem.x, dem.y, CASE WHEN dem.h IS NOT NULL THEN dem.h + 500 - CASE WHEN wet.x IS NOT NULL THEN 32768 ELSE 0 END END AS v FROM dem LEFT JOIN wet USING (x, y)"


_FWD = f"CAST(round_even(x / 1200.0 * ({PI} / 180) * 40000, 0) AS INT) AS px, CAST(round_even(ln(tan({PI} / 4 + y / 1200.0 * ({PI} / 180) / 2)) * 40000, 0) AS INT) AS py"


@query("shade_water_outline", COVER, "--withd AS (SELECT CAST(i % 66 - 1 AS INT) AS x, CAST(i // 66 - 1 AS INT) AS y FROM (SELECT unnest(range(66 * 66)) AS i)), l AS (SELECT d.x, d.y FROM d LEFT JOIN t USING (x, y) WHERE t.h IS DISTINCT FROM 80), k AS (SELECT t.x, t.y, min(abs(t.x - l.x) + abs(t.y - l.y)) AS dist FROM t, l WHERE t.h = 80 GROUP BY t.x, t.y) SELECT DISTINCT " + _FWD + ", 255 AS rgba FROM k WHERE dist <= 3")
def _(t):
    flags = raster.extract(t, 0, 0, 64, 64).withColumn("h", F.coalesce(water.monochrome(c("h")), F.lit(0)))
    return water.outline_pixels(flags, projections.Mercator(40000.0), 1200.0).withColumn("rgba", F.lit(255))


# --- pictures through a projection ----------------------------------------------------------------------------------

#: 1.37 cells of 1/1200 degree for each map unit.
_UNITS = 1200 * 180 / math.pi / 1.37
_AT = {k: (f"((x + {k % 3 - 1}) / {_UNITS!r}::DOUBLE)", f"(2.0 * atan(exp((y + {k // 3 - 1}) / {_UNITS!r}::DOUBLE)) - {PI}::DOUBLE / 2)") for k in (0, 1, 3, 4)}
_PROJECTED = (
    "--withd AS (SELECT CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y FROM (SELECT unnest(range(4096)) AS i)), f AS (SELECT d.x, d.y, t.h FROM d LEFT JOIN t USING (x, y)), "
    f"g AS (SELECT x, y, {_AT[4][0]} * 180.0::DOUBLE / {PI}::DOUBLE * 1200 AS gx, {_AT[4][1]} * 180.0::DOUBLE / {PI}::DOUBLE * 1200 AS gy FROM (SELECT CAST(i % 42 + 1 AS INT) AS x, CAST(i // 42 + 1 AS INT) AS y FROM (SELECT unnest(range(1764)) AS i))), "
    "b AS (SELECT g.x, g.y, (((CAST(q.h - e.h AS DOUBLE) * (gx - floor(gx)) + e.h) - (CAST(r.h - a.h AS DOUBLE) * (gx - floor(gx)) + a.h)) * (gy - floor(gy)) + (CAST(r.h - a.h AS DOUBLE) * (gx - floor(gx)) + a.h)) AS h FROM g LEFT JOIN f a ON a.x = floor(gx) AND a.y = floor(gy) LEFT JOIN f r ON r.x = floor(gx) + 1 AND r.y = floor(gy) LEFT JOIN f e ON e.x = floor(gx) AND e.y = floor(gy) + 1 LEFT JOIN f q ON q.x = floor(gx) + 1 AND q.y = floor(gy) + 1), "
    + _N9.format(s="b")
    + f", m AS (SELECT *, {hav_sql(*_AT[0], *_AT[1])} AS w, {hav_sql(*_AT[0], *_AT[3])} AS hgt FROM n WHERE x BETWEEN 2 AND 41 AND y BETWEEN 2 AND 41), "
    + re.sub(r"\bh([0-8])\b", r"n\1", f"s AS (SELECT x, y, h AS height, {_SLOPE} AS slope, {_ASPECT} AS aspect FROM m)")
)


def _projected(t: DataFrame) -> DataFrame:
    return shading.projected_pixels(_dense(t), projections.Mercator(_UNITS), (2, 2, 40, 40), 1200.0)


@query("projected_slope_aspect", DEM, _PROJECTED + " SELECT x, y, round(height, 5) AS height, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM s")
def _(t):
    return _projected(t).select("x", "y", F.round("height", 5).alias("height"), F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


@query("shade_projected", DEM, _PROJECTED + f", p AS (SELECT x, y, {elevation_sql('height')} AS e, {_NZ.format(e=igor_sql('slope', 'aspect'))} AS i FROM s) SELECT x - 2 AS x, 41 - y AS y, {over_sql('i', 'e')} AS rgba FROM p")
def _(t):
    return shading.flipped(shading.shaded(_projected(t), shading.DEFAULT), (2, 2, 40, 40))


# --- files by the batch ---------------------------------------------------------------------------------------------


def _named_tiles(t: DataFrame) -> DataFrame:
    return grids.to_tiles(t, 32, "hgt").select(F.concat(coords.tile_name(c("tile_x"), c("tile_y")), F.lit(".hgt")).alias("name"), "content")


@query("zip_roundtrip", DEM, "SELECT x, y, h FROM t")
def _(t):
    packed_ = archives.zip_tiles(_named_tiles(t).withColumn("name", F.regexp_replace("name", "[.]hgt$", "")))
    return archives.read_batch(archives.unzip(packed_, "[.]hgt$").select("name", "content"), 32, "hgt").join(t.select("x", "y"), ["x", "y"], "left_semi")


@query("batch_errors", DEM, "SELECT DISTINCT CASE WHEN x // 32 = 1 THEN 'N0' || (y // 32) || 'E00' || (x // 32) || '.hgt' END AS name FROM t WHERE x // 32 = 1")
def _(t):
    damaged = _named_tiles(t).withColumn("content", F.when(c("name").contains("E001"), F.substring("content", 1, 100)).otherwise(c("content")))
    return archives.decode_all(damaged, 32, "hgt").where("error is not null").select("name")


@query("tiff_roundtrip", DEM, "SELECT x * 2 + k AS x, y, coalesce(h, -9999) AS h FROM t CROSS JOIN (VALUES (0), (1)) AS v(k) WHERE y >= 16")
def _(t):
    import numpy as np
    import pandas as pd

    def pack(cells: pd.DataFrame) -> pd.DataFrame:
        image = np.full((64, 64), -9999, np.int16)
        image[63 - cells["y"], cells["x"]] = cells["h"].fillna(-9999).astype(np.int16)
        return pd.DataFrame({"path": ["a.tif"], "content": [archives.encode_tiff(image, 16)]})

    files = t.groupBy(F.lit("a.tif").alias("path")).applyInPandas(pack, "path string, content binary")
    found = archives.tiff_cells(files, 2, (0, 0, 64, 48)).select("x", (c("y") + 16).alias("y"), "h")
    return found.join(t.select(F.explode(F.array(c("x") * 2, c("x") * 2 + 1)).alias("x"), "y"), ["x", "y"], "left_semi")


@query("geojson_tiles", "SELECT n_nationkey AS id, CAST(n_nationkey * 37 % 80 AS INT) AS y, CAST(n_nationkey * 53 % 170 AS INT) AS x FROM nation", "SELECT 'N' || lpad(CAST(y AS VARCHAR), 2, '0') || 'W' || lpad(CAST(x AS VARCHAR), 3, '0') AS name, -x AS tile_x, y AS tile_y FROM t")
def _(t):
    feature = F.format_string('{"type": "Feature", "properties": {"ll_tile": "N%02dW%03d"}, "geometry": null}', c("y"), c("x"))
    text = t.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    return archives.listed_tiles(text)
