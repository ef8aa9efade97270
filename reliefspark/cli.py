"""python -m reliefspark.cli shade CELLS.parquet OUT: cells (x, y, h) to shaded pictures by a script.

Exit codes: 0 done, 1 bad arguments, 2 bad script."""

from __future__ import annotations

import argparse
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .operators.raster import extract, level_up
from .plans import script, shading
from .sources.grids import encode_png


def pictures(pixels: DataFrame, tile_size: int, prefix: str = "shading") -> DataFrame:
    """(name, content): PNG tiles of (x, y, rgba); y grows north, row 0 of a picture is on top."""

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((tile_size, tile_size, 4), np.uint8)
        c = pdf["rgba"].to_numpy(np.int64)
        image[tile_size - 1 - (pdf["y"] - key[1] * tile_size), pdf["x"] - key[0] * tile_size] = np.stack([c >> 24 & 255, c >> 16 & 255, c >> 8 & 255, c & 255], axis=1)
        return pd.DataFrame({"name": [f"{prefix}-{key[0]:02d}-{key[1]:02d}.png"], "content": [encode_png(image, "rgba8")]})

    keyed = pixels.selectExpr("x", "y", "rgba", f"floor(x / {tile_size}) as tx", f"floor(y / {tile_size}) as ty")
    return keyed.groupBy("tx", "ty").applyInPandas(draw, "name string, content binary")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reliefspark")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("shade", help="shade a raster")
    s.add_argument("cells")
    s.add_argument("output")
    s.add_argument("--shading-script", default="elecolor |+ igor")
    s.add_argument("--tile-size", type=int, default=1000)
    s.add_argument("--file-prefix", default="shading")
    s.add_argument("--origin", default="0,0", help="lon,lat of cell 0,0")
    s.add_argument("--cells-per-degree", type=float, default=3600)
    u = commands.add_parser("pyramid", help="one level up")
    u.add_argument("cells")
    u.add_argument("output")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    spark = spark or SparkSession.builder.getOrCreate()
    cells = spark.read.parquet(a.cells)
    if a.command == "pyramid":
        level_up(cells).write.mode("overwrite").parquet(a.output)
        return 0
    try:
        plan = script.build(a.shading_script)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    box = cells.selectExpr("min(x) as x0", "min(y) as y0", "max(x) - min(x) + 1 as w", "max(y) - min(y) + 1 as h").first()
    lon, lat = map(float, a.origin.split(","))
    dense = extract(cells, box.x0, box.y0, box.w, box.h)
    pixels = shading.shaded(shading.terrain_pixels(dense, lon, lat, a.cells_per_degree), plan)
    pictures(pixels, a.tile_size, a.file_prefix).write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
