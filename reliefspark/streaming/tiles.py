"""Tiles that arrive over time: new files become cells, and the pyramid above them is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.coords import parse_tile_name
from ..operators.raster import pyramid
from ..sources.grids import from_tiles


def arriving(spark: SparkSession, folder: str, pattern: str = "*.hgt") -> DataFrame:
    """A stream of (tile_x, tile_y, content) of files named like N46E015.hgt."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    x, y = parse_tile_name(name)
    return files.select(x.alias("tile_x"), y.alias("tile_y"), "content").where("tile_x is not null")


def keep_pyramid(stream: DataFrame, size: int, how: str, out: str, checkpoint: str, levels: int = 2) -> StreamingQuery:
    """Writes each batch's cells and the levels above them, by level and batch. A batch that is run again replaces its own
    output, so each tile counts once."""

    def write(batch: DataFrame, number: int) -> None:
        cells = from_tiles(batch, size, how)
        every = cells.select(F.lit(0).alias("level"), "x", "y", "h").unionByName(pyramid(cells, levels))
        every.write.mode("overwrite").partitionBy("level").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
