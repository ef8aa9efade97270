"""Shading plans: leaves and compositions, compiled to one Column over a relation that has height, slope and aspect.

Height, slope and aspect are computed once per pixel, whatever the number of leaves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, terrain
from ..functions.projections import haversine
from ..functions.angles import rad_to_deg
from ..operators.raster import canvas, neighbourhood

Shader = Callable[..., Column]

#: A leaf's function takes the columns height, slope, aspect and its own parameters.
SHADERS: dict[str, Shader] = {
    "elecolor": lambda height, slope, aspect, scale=terrain.DEFAULT_SCALE, none=0: terrain.elevation_color(height, scale, none),
    "igor": lambda height, slope, aspect, **p: terrain.igor(slope, aspect, **p),
    "lambert": lambda height, slope, aspect, **p: terrain.lambert(slope, aspect, **p),
    "slope": lambda height, slope, aspect, **p: terrain.slope_color(slope, **p),
    "aspect": lambda height, slope, aspect, **p: terrain.aspect_color(aspect, **p),
    "solid": lambda height, slope, aspect, rgba=color.literal(255, 255, 255): F.lit(rgba).cast("long"),
}
COMPOSITORS: dict[str, Callable[[Column, Column], Column]] = {"over": color.over, "alpha-darken": color.darken}


def register_shader(name: str, shader: Shader) -> None:
    SHADERS[name] = shader


def register_compositor(name: str, compositor: Callable[[Column, Column], Column]) -> None:
    COMPOSITORS[name] = compositor


@dataclass(frozen=True)
class Leaf:
    shader: str
    parameters: dict[str, Any] = field(default_factory=dict)

    def column(self, height: Column, slope: Column, aspect: Column) -> Column:
        if self.shader not in SHADERS:
            raise ValueError(f"Unknown shader: '{self.shader}'")
        return SHADERS[self.shader](height, slope, aspect, **self.parameters)


@dataclass(frozen=True)
class Composite:
    """source laid on dest."""

    dest: Leaf | Composite
    source: Leaf | Composite
    how: str = "over"

    def column(self, height: Column, slope: Column, aspect: Column) -> Column:
        if self.how not in COMPOSITORS:
            raise ValueError(f"Unknown compositing function: '{self.how}'")
        return COMPOSITORS[self.how](self.source.column(height, slope, aspect), self.dest.column(height, slope, aspect))


DEFAULT = Composite(Leaf("elecolor"), Leaf("igor"))
TILE = Composite(Leaf("solid"), Composite(Composite(Leaf("slope"), Leaf("lambert"), "alpha-darken"), Leaf("igor"), "alpha-darken"))


def shaded(terrain_pixels: DataFrame, plan: Leaf | Composite) -> DataFrame:
    """(x, y, rgba) of (x, y, height, slope, aspect). Stacked compositions are built up column by column, so that each is
    evaluated once."""
    df, count = terrain_pixels, 0

    def visit(p: Leaf | Composite) -> Column:
        nonlocal df, count
        if isinstance(p, Leaf):
            made = p.column(F.col("height"), F.col("slope"), F.col("aspect"))
        else:
            if p.how not in COMPOSITORS:
                raise ValueError(f"Unknown compositing function: '{p.how}'")
            dest, source = visit(p.dest), visit(p.source)
            made = COMPOSITORS[p.how](source, dest)
        count += 1
        df = df.withColumn(f"_c{count}", made)
        return F.col(f"_c{count}")

    top = visit(plan)
    return df.select("x", "y", top.alias("rgba"))


def terrain_pixels(cells: DataFrame, lon0: float, lat0: float, cells_per_degree: float, dx: float = 0.25, dy: float = 0.5) -> DataFrame:
    """(x, y, height, slope, aspect): heights interpolated at an offset in each cell, and derivatives of their 3x3
    neighbourhoods. The raster must be dense; pixels next to what is missing have null derivatives.

    Two passes over the same blocks: bilinear heights first, then the gradient of these."""
    n = neighbourhood(cells)
    sampled = n.select("x", "y", terrain.bilinear(F.col("n4"), F.col("n5"), F.col("n7"), F.col("n8"), F.lit(dx), F.lit(dy)).alias("height"))
    m = neighbourhood(sampled, "height")
    rad = 3.141592653589793 / 180.0
    lon = [(F.lit(lon0) + (F.col("x") + k) / F.lit(cells_per_degree)) * rad for k in (-1, 0)]
    lat = [(F.lit(lat0) + (F.col("y") + k) / F.lit(cells_per_degree)) * rad for k in (-1, 0)]
    m = m.withColumn("gw", haversine(lon[0], lat[0], lon[1], lat[0])).withColumn("gh", haversine(lon[0], lat[0], lon[0], lat[1]))
    p, q = terrain.horn([F.col(f"n{k}") for k in range(9)], F.col("gw"), F.col("gh"))
    m = m.withColumn("p", p).withColumn("q", q)
    slope, aspect = terrain.slope_aspect(F.col("p"), F.col("q"))
    return m.select("x", "y", "height", slope.alias("slope"), aspect.alias("aspect"))


def projected_pixels(cells: DataFrame, projection: Any, rect: tuple[int, int, int, int], cells_per_degree: float) -> DataFrame:
    """(x, y, height, slope, aspect) of the pixels of rect (min_x, min_y, width, height) of a map: each pixel is taken back through
    the projection to the ground, its height is interpolated between four cells there, and slope and aspect come from the
    pixels around it and the distances between their places on the ground.

    Pixels next to one that has no place or no height have null derivatives. The raster must be dense (see raster.extract).
    One equi-join by cell, and neighbourhoods in blocks on both sides of it."""
    x0, y0, w, h = rect
    lattice = canvas(cells.sparkSession, x0 - 1, y0 - 1, w + 2, h + 2)
    lon, lat = projection.inverse(F.col("x").cast("double"), F.col("y").cast("double"))
    lattice = lattice.withColumn("lon", lon).withColumn("lat", lat)
    lattice = lattice.withColumn("gx", rad_to_deg(F.col("lon")) * cells_per_degree).withColumn("gy", rad_to_deg(F.col("lat")) * cells_per_degree)
    lattice = lattice.withColumn("cx", F.floor("gx").cast("int")).withColumn("cy", F.floor("gy").cast("int"))
    corners = neighbourhood(cells).select(F.col("x").alias("cx"), F.col("y").alias("cy"), "n4", "n5", "n7", "n8")
    height = terrain.bilinear(F.col("n4"), F.col("n5"), F.col("n7"), F.col("n8"), F.col("gx") - F.col("cx"), F.col("gy") - F.col("cy"))
    sampled = lattice.join(corners, ["cx", "cy"], "left").select("x", "y", F.struct(height.alias("h"), "lon", "lat").alias("at"))
    n = neighbourhood(sampled, "at")
    inside = F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)
    wide = haversine(*[F.col(f"n{k}.{c}") for k in (0, 1) for c in ("lon", "lat")])
    high = haversine(*[F.col(f"n{k}.{c}") for k in (0, 3) for c in ("lon", "lat")])
    p, q = terrain.horn([F.col(f"n{k}.h") for k in range(9)], F.col("_wide"), F.col("_high"))
    n = n.where(inside).withColumn("_wide", wide).withColumn("_high", high).withColumn("_p", p).withColumn("_q", q)
    slope, aspect = terrain.slope_aspect(F.col("_p"), F.col("_q"))
    return n.select("x", "y", F.col("at.h").alias("height"), slope.alias("slope"), aspect.alias("aspect"))


def flipped(pixels: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """Pixels of a map, y growing north, as rows of a picture from its top left."""
    x0, y0, _, h = rect
    return pixels.withColumn("x", F.col("x") - x0).withColumn("y", F.lit(y0 + h - 1) - F.col("y"))
