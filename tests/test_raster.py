import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions import projections, terrain
from reliefspark.operators import contours, geometry, raster, tiles, water
from reliefspark.plans import script, shading
from reliefspark.sources import grids


def cells(spark, rows):
    return spark.createDataFrame([(x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "x int, y int, h int")


SCENE = ["0000100", "0010100", "1011110", "1111100", "0011100", "0011000", "0001000"]


def scene(spark):
    return cells(spark, [[int(c) for c in row] for row in SCENE])


def test_one_water_body(spark):
    c = water.components(scene(spark), 7)
    s = water.component_stats(c).collect()
    assert [(r.color, r.surface_area, r.width, r.height) for r in s] == [(2, 19, 6, 7)]


def test_components_across_blocks_against_flood_fill(spark):
    rng = random.Random(4)
    n = 30
    g = [[int(rng.random() < 0.55) for _ in range(n)] for _ in range(n)]
    got = {(r.x, r.y): r.color for r in water.components(cells(spark, g), n, block=8).collect()}
    seen, color = {}, 2
    for y in range(n):
        for x in range(n):
            if g[y][x] and (x, y) not in seen:
                stack = [(x, y)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < n and 0 <= b < n and g[b][a] and (a, b) not in seen:
                        seen[a, b] = color
                        stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
                color += 1
    assert got == seen


def test_distance_to_shore(spark):
    d = {(r.x, r.y): r.dist for r in water.distance_to_shore(scene(spark)).collect()}
    assert d[3, 3] == 2 and d[4, 0] == 1 and d[2, 4] == 1 and d[3, 4] == 2


def test_merge_keeps_the_last_also_if_missing(spark):
    p = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, None), (1, 1, 0, 7)], "src_ord int, x int, y int, h int")
    assert {(r.x, r.h) for r in raster.merge(p).collect()} == {(0, None), (1, 7)}


def test_average_rounds_half_to_even_and_skips_missing(spark):
    assert raster.level_up(cells(spark, [[100, 150], [50, -103]])).first().h == 49
    assert raster.level_up(cells(spark, [[None, None], [None, None]])).first().h is None


def test_neighbourhood_over_block_edges(spark):
    n = 12
    g = np.arange(n * n).reshape(n, n)
    got = {(r.x, r.y): [r[f"n{k}"] for k in range(9)] for r in raster.neighbourhood(cells(spark, g.tolist()), block=5).collect()}
    assert len(got) == n * n
    for (x, y), v in got.items():
        want = [int(g[y + dy, x + dx]) if 0 <= x + dx < n and 0 <= y + dy < n else None for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        assert v == want


def test_known_values(spark):
    one = spark.range(1)
    v = one.select(terrain.bilinear(F.lit(11.0), F.lit(-4.0), F.lit(-5.0), F.lit(4.0), F.lit(0.088), F.lit(0.786)).alias("v")).first().v
    assert abs(v + 1.235968) < 1e-6
    scale = ((700, 0x64646464), (1000, 0xC8C8C8C8))
    got = [one.select(terrain.elevation_color(F.lit(h).cast("double"), scale).alias("c")).first().c for h in (500, 850, 1200, None)]
    assert got == [0x64646464, 0x96969696, 0xC8C8C8C8, 0]
    lcc = projections.LambertConformalConic(25, 55)
    x, y = lcc.forward(F.radians(F.lit(10.0)), F.radians(F.lit(45.0)))
    r = one.select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 762227.613999) < 1e-3 and abs(r.y - 5215404.28979) < 1e-3
    with pytest.raises(ValueError):
        projections.LambertConformalConic(30, -30)


def test_isoline_of_a_peak_is_closed(spark):
    lines = contours.isolines(cells(spark, [[0, 0, 0], [0, 100, 0], [0, 0, 0]]), 50).collect()
    assert len(lines) == 4 and len({r.isoline for r in lines}) == 1 and all(r.closed for r in lines)


def test_closure_stops_at_cached_tiles(spark):
    t = spark.createDataFrame([(2, 0, 0)], "level int, tile_x int, tile_y int")
    assert tiles.required_closure(t).count() == 21
    assert tiles.required_closure(t, spark.createDataFrame([(1, 0, 0)], t.schema)).count() == 17


def test_crossings_of_large_and_odd_polygons(spark, monkeypatch):
    """A star of 4,001 edges, each of which crosses 1,998 others, within a minute; small blocks against the class of each pair."""
    n, begin = 4001, time.monotonic()
    star = [(0, k, 1e6 * math.cos(2000 * math.pi * k / n), 1e6 * math.sin(2000 * math.pi * k / n)) for k in range(n)]
    schema = "id int, ord int, x double, y double"
    assert [tuple(r) for r in geometry.self_intersecting(spark.createDataFrame(star, schema)).collect()] == [(0, n, n * 999)]
    assert time.monotonic() - begin < 60
    monkeypatch.setattr(geometry, "BLOCK_EDGES", 7)
    monkeypatch.setattr(geometry, "TILE_EDGES", 3)
    rng = random.Random(4)
    rows = [(i, k, float(rng.randrange(5)), float(rng.randrange(5))) for i in range(8) for k in range((1, 2, 3, 4, 20, 40, 50, 60)[i])]
    rows += [(8, k, None if k % 7 == 3 else float(rng.randrange(5)), None if k % 5 == 2 else float(rng.randrange(5))) for k in range(40)] + [(None, k, float(k % 3), float(k % 2)) for k in range(9)]
    points = spark.createDataFrame(rows, schema)
    e = geometry.polygon_edges(points)
    a, b = (e.select("id", *[F.col(c).alias(p + c) for c in e.columns[1:]]) for p in "ab")
    kind = geometry.intersection_class(*[(F.col(p + "x" + k), F.col(p + "y" + k)) for p in "ab" for k in "12"])
    pairs = a.join(b, "id").where("aedge < bedge - 1 and least(ay1, ay2) <= greatest(by1, by2) and greatest(ay1, ay2) >= least(by1, by2)").select("id", "aedge", "bedge", kind.alias("kind")).collect()
    edges = {r.id: r["count"] for r in e.groupBy("id").count().collect()}
    want = {i: (k, sum(r.id == i and r.kind != "NotIntersect" and not (r.aedge == 0 and r.bedge == k - 1) for r in pairs)) for i, k in edges.items()}
    assert {r.id: (r.edges, r.crossings) for r in geometry.self_intersecting(points).collect()} == want and want[None][1] == 0 < want[8][1]


def test_segment_rounding(spark):
    p = [(F.lit(x), F.lit(y)) for x, y in ((69.06, 48.87), (95.6, 57.5), (88.965, 55.3425), (27.5, 11.04))]
    r = spark.range(1).select(geometry.intersection_class(*p).alias("a"), geometry.intersection_point(*p)[0].alias("b")).first()
    assert (r.a, r.b) == ("OneEndpointLiesOnOtherSegment",) * 2


def test_grid_bytes():
    data = bytes.fromhex("000000000000" "0A0000000101" "0A0100010101")
    assert grids.decode_grid(data, 2).reshape(-1).tolist() == [2561, 1, 2560, 0]
    assert grids.decode_grid(bytes.fromhex("00000000FF9C0000"), 1).tolist() == [[-100]]


@pytest.mark.parametrize("kind,shape,top", [("gray1", (9, 13), 2), ("gray8", (7, 5), 256), ("gray16", (6, 6), 65536), ("rgba8", (5, 8, 4), 256)])
def test_png_roundtrip(kind, shape, top):
    image = np.random.default_rng(1).integers(0, top, shape)
    name, back = grids.decode_png(grids.encode_png(image, kind))
    assert name == kind and (back == image).all()
    with pytest.raises(ValueError):
        grids.decode_png(grids.encode_png(image, kind)[:-20])


def test_scripts():
    assert script.parse_steps("shader1(par1='1 2') |+ shader2(par2 = ' 23')") == [("shader1", {"par1": "1 2"}), ("shader2", {"par2": " 23"})]
    plan = script.build("elecolor(scale='-1:#00000000;1000:#ffffff;none:#00000000') |+ igor")
    assert isinstance(plan, shading.Composite) and plan.dest.parameters["scale"] == ((-1, 0), (1000, 0xFFFFFFFF))
    for bad in ("   ", "elecolor |+", "nothing", "igor(x=1)"):
        with pytest.raises(ValueError):
            script.build(bad)
    marks = script.parse_scale("1:#102030;5:#40506070;none:#00000000")
    assert script.parse_scale(script.scale_to_text(*marks)) == marks
    for text, column in (("proj=merc", 0), ("+proj=merc lat_ts=56.5", 11), ("+=merc", 1)):
        with pytest.raises(script.ScriptError) as e:
            script.parse_projection(text)
        assert e.value.column == column


def test_stream_and_command_line(spark, tmp_path):
    from reliefspark import cli
    from reliefspark.streaming import tiles as stream

    (tmp_path / "in").mkdir()
    grid = np.arange(16, dtype=np.int16).reshape(4, 4)
    (tmp_path / "in/N00E001.hgt").write_bytes(grids.encode_grid(grid))
    q = stream.keep_pyramid(stream.arriving(spark, str(tmp_path / "in")), 4, "hgt", str(tmp_path / "out"), str(tmp_path / "cp"), levels=1)
    q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.level: r["count"] for r in out.groupBy("level").count().collect()} == {0: 16, 1: 4}
    out.where("level = 0").select("x", "y", "h").write.parquet(str(tmp_path / "cells"))
    assert cli.main(["shade", str(tmp_path / "cells"), str(tmp_path / "png"), "--tile-size", "8"], spark) == 0
    picture = spark.read.parquet(str(tmp_path / "png")).first()
    assert grids.decode_png(bytes(picture.content))[1].shape == (8, 8, 4)
    assert cli.main(["shade", str(tmp_path / "cells"), "x", "--shading-script", "what"], spark) == 2
    assert cli.main(["nothing"], spark) == 1


def test_tiff_windows_and_damage():
    from reliefspark.sources import archives

    image = np.random.default_rng(2).integers(-3000, 3000, (50, 70)).astype(np.int16)
    data = archives.encode_tiff(image, 16)
    assert (archives.decode_tiff(data) == image).all() and (archives.decode_tiff(data, (5, 7, 40, 20)) == image[7:27, 5:45]).all()
    for bad in (data[:-3], b"II+\0" + data[4:]):
        with pytest.raises(ValueError):
            archives.decode_tiff(bad)
    with pytest.raises(ValueError):
        archives.decode_tiff(data, (60, 0, 20, 10))


def test_batch_names_every_damaged_tile(spark):
    from reliefspark.sources import archives

    good = grids.encode_tile(np.arange(4, dtype=np.int16).reshape(2, 2), "png16")
    files = spark.createDataFrame([("a/N01E002.png", good), ("N03W004.png", good[:20]), ("hello.png", good)], "name string, content binary")
    with pytest.raises(ValueError, match="N03W004.*hello"):
        archives.read_batch(files, 2, "png16")
    assert {(r.x, r.y, r.h) for r in archives.read_batch(files.where("name like 'a/%'"), 2, "png16").collect()} == {(4, 2, 0), (5, 2, 1), (4, 3, 2), (5, 3, 3)}


def test_projected_pixels_over_blocks(spark):
    """A raster wider than a block, on a plane: slope and aspect are the same everywhere."""
    n = 300
    plane = raster.canvas(spark, 0, 0, n, 12).withColumn("h", F.col("x") * 10)
    units = 1200 * 180 / np.pi / 1.3
    got = shading.projected_pixels(plane, projections.Mercator(units), (2, 2, 220, 5), 1200.0).agg(F.count("slope").alias("n"), F.min("slope").alias("a"), F.max("slope").alias("b")).first()
    assert got.n == 1100 and got.b - got.a < 1e-6 and got.a > 0.1


@pytest.mark.parametrize("pixel", [1, 2, 4])
def test_unfilter_undoes_each_filter(pixel):
    """Rows filtered by the definition of each of the five filters."""
    rows = np.random.default_rng(pixel).integers(0, 256, (10, 24)).astype(int)
    data = bytearray()
    for y, row in enumerate(rows):
        kind = y % 5
        data.append(kind)
        for x, v in enumerate(row.tolist()):
            a = int(rows[y, x - pixel]) if x >= pixel else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - pixel]) if y and x >= pixel else 0
            p = a + b - c
            near = min((a, b, c), key=lambda k: abs(p - k))
            data.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    assert (grids.unfilter_rows(bytes(data), 10, 24, pixel) == rows).all()
