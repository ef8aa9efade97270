"""Water bodies: classification, connected components, distance to shore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .raster import downsample

#: Land-cover class of permanent water.
WATER_CLASS = 80
#: Side of the blocks that components are labelled in before their rims are joined.
BLOCK = 256


def monochrome(cover: Column) -> Column:
    return F.when(cover == WATER_CLASS, 1).otherwise(0)


def downsample_water(cells: DataFrame, factor: float, width: int, height: int) -> DataFrame:
    """1 where more than half of the area is water."""
    share = downsample(cells.withColumn("h", F.col("h") * 1_000_000), factor, width, height)
    return share.withColumn("h", F.when(F.col("h") > 500_000, 1).otherwise(0))


def _label_block(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """Union-find by array passes within one block: each water cell gets the smallest cell number of its piece."""
    bx, by = int(pdf["bx"].iloc[0]), int(pdf["by"].iloc[0])
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    grid = np.full((block, block), np.iinfo(np.int64).max)
    ly, lx = y - by * block, x - bx * block
    grid[ly, lx] = pdf["cell"].to_numpy()
    water = grid < np.iinfo(np.int64).max
    parent = {int(c): int(c) for c in grid[water]}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for a, b in ((grid[:, :-1], grid[:, 1:]), (grid[:-1], grid[1:])):
        both = (a < np.iinfo(np.int64).max) & (b < np.iinfo(np.int64).max)
        for p, q in zip(a[both].tolist(), b[both].tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
    pdf = pdf.copy()
    pdf["label"] = [find(int(c)) for c in pdf["cell"]]
    return pdf[["x", "y", "cell", "label"]]


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): rounds of 'take the smallest root among neighbours, then the root of that
    root', until no root changes. Hubs are aggregated before they are shuffled."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("r"))
        step = roots.join(near, roots["node"] == near["a"]).select("node", F.least("root", "r").alias("root"))
        jump = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        after = materialize(step.join(jump, step["root"] == jump["n2"]).select("node", F.least("root", "r2").alias("root")), "roots")
        if not after.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count():
            return after
        roots = after


def components(cells: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(x, y, color) of water cells (h = 1): 4-connected bodies, numbered from 2 in order of their first cell, row by row.

    Pieces are labelled within blocks, the rims of blocks give edges between pieces, and only pieces are joined again."""
    water = cells.where("h = 1").select("x", "y", (F.col("y").cast("long") * width + F.col("x")).alias("cell"))
    blocks = water.withColumn("bx", F.floor(F.col("x") / block)).withColumn("by", F.floor(F.col("y") / block))
    labelled = materialize(blocks.groupBy("bx", "by").applyInPandas(lambda pdf: _label_block(pdf, block), "x int, y int, cell long, label long"), "labels")
    edges = labelled.select(F.col("label").alias("a"), F.col("label").alias("b")).distinct()
    for dx, dy in ((1, 0), (0, 1)):
        rim = labelled.where((F.pmod(F.col("x" if dx else "y") + 1, F.lit(block)) == 0))
        other = labelled.where((F.pmod(F.col("x" if dx else "y"), F.lit(block)) == 0)).select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("label").alias("b"))
        edges = edges.union(rim.join(other, ["x", "y"]).select(F.col("label").alias("a"), "b"))
    roots = smallest_reachable(edges.distinct())
    # bodies, not cells, are numbered in one ordered pass
    numbered = roots.select("root").distinct().withColumn("color", (F.row_number().over(Window.orderBy("root")) + 1).cast("int"))
    return labelled.join(roots.join(numbered, "root"), labelled["label"] == roots["node"]).select("x", "y", "color")


def component_stats(colored: DataFrame) -> DataFrame:
    """Area and bounding rectangle of each body."""
    return colored.groupBy("color").agg(F.count("*").alias("surface_area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def shown(area: Column, width: Column, height: Column) -> Column:
    """Whether a body is drawn: large enough, and not too thin for its rectangle."""
    return (area >= 1250) & (F.floor(width * height / area) < 10)


def distance_to_shore(cells: DataFrame) -> DataFrame:
    """(x, y, dist) of water cells: steps to the nearest cell that is no water; outside the raster is land.

    The L1 distance is separable: nearest land along the row, then the least of that plus the way along the column, each
    by two running windows. A rim of land is added first."""
    box = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    land_x = F.when(F.col("h") != 1, F.col("x"))
    up = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("y").orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    g = cells.crossJoin(F.broadcast(box)).withColumn("left", F.coalesce(F.max(land_x).over(up), F.col("x0") - 1)).withColumn("right", F.coalesce(F.min(land_x).over(down), F.col("x1") + 1))
    g = g.withColumn("g", F.least(F.col("x") - F.col("left"), F.col("right") - F.col("x")))
    col = Window.partitionBy("x").orderBy("y")
    below = F.min(F.col("g") - F.col("y")).over(col.rowsBetween(Window.unboundedPreceding, 0)) + F.col("y")
    above = F.min(F.col("g") + F.col("y")).over(col.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    rim = F.least(F.col("y") - F.col("y0") + 1, F.col("y1") + 1 - F.col("y"))
    return g.withColumn("dist", F.least(below, above, rim).cast("int")).where("h = 1").select("x", "y", "dist")


#: Fixed value: colour of water, rgba.
WATER_COLOR = 0x49C8FFFF


def flag_color(h: Column, rgba: int = WATER_COLOR) -> Column:
    """Colour of cells whose lowest bit is set, as heights with a water flag have it; other and missing cells are clear."""
    return F.when(h % 2 == 1, F.lit(rgba)).otherwise(F.lit(0)).cast("long")


def body_color(cover: DataFrame, width: int, rgba: int = WATER_COLOR) -> DataFrame:
    """(x, y, rgba) of a land-cover raster (x, y, h): cells of water bodies that `shown` lets pass - by area, and by how much of the
    rectangle around them they fill - have the colour, all others are clear."""
    flags = cover.withColumn("h", monochrome(F.col("h")))
    found = components(flags, width)
    kept = component_stats(found).where(shown(F.col("surface_area"), F.col("width"), F.col("height"))).select("color")
    cells = found.join(kept, "color", "left_semi").select("x", "y", F.lit(rgba).cast("long").alias("_rgba"))
    return cover.select("x", "y").join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("_rgba", F.lit(0).cast("long")).alias("rgba"))


def dem_with_water(dem: DataFrame, cover: DataFrame, width: int) -> DataFrame:
    """(x, y, v): heights of dem (x, y, h) with the water flag of the bodies of a land-cover raster that are `shown`, encoded as
    the water format has it; null where the height is missing."""
    from .raster import encode_water

    wet = body_color(cover, width).where("rgba <> 0").select("x", "y", F.lit(1).alias("_wet"))
    both = dem.join(wet, ["x", "y"], "left")
    return both.select("x", "y", F.when(F.col("h").isNotNull(), encode_water(F.col("h"), F.coalesce("_wet", F.lit(0)))).alias("v"))


def outline_pixels(cover: DataFrame, projection: object, cells_per_degree: float, reach: int = 3) -> DataFrame:
    """(px, py) of the map pixels nearest to the water cells within `reach` of the shore. cover must be dense, 1 for water."""
    near = distance_to_shore(cover).where(F.col("dist") <= reach)
    x, y = projection.forward(F.radians(F.col("x") / cells_per_degree), F.radians(F.col("y") / cells_per_degree))
    return near.select(F.rint(x).cast("int").alias("px"), F.rint(y).cast("int").alias("py")).where("px is not null and py is not null").distinct()
