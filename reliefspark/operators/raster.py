"""Raster algebra on cells (x, y, h): a missing height is null, y grows north."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Side of the blocks that neighbourhood operators are partitioned by.
BLOCK = 256


def canvas(spark: SparkSession, min_x: int, min_y: int, width: int, height: int) -> DataFrame:
    """(x, y) of every cell of a rectangle."""
    n = width * height
    return spark.range(n).select((F.col("id") % max(width, 1) + min_x).cast("int").alias("x"), (F.floor(F.col("id") / max(width, 1)) + min_y).cast("int").alias("y"))


def merge(parts: DataFrame, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Mosaic of (src_ord, x, y, h): the largest src_ord that has the cell wins, also with a missing height.

    bounds: (min_x, min_y, width, height); cells of it that no part has are missing ones."""
    if bounds:
        x0, y0, w, h = bounds
        parts = parts.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    merged = parts.groupBy("x", "y").agg(F.max_by("h", "src_ord").alias("h"))
    return extract(merged, *bounds) if bounds else merged


def extract(cells: DataFrame, min_x: int, min_y: int, width: int, height: int) -> DataFrame:
    """Crop and pad: every cell of the rectangle, missing where the raster has none."""
    inside = cells.where(F.col("x").between(min_x, min_x + width - 1) & F.col("y").between(min_y, min_y + height - 1))
    return canvas(cells.sparkSession, min_x, min_y, width, height).join(inside, ["x", "y"], "left").select("x", "y", "h")


def in_blocks(cells: DataFrame, halo: int = 1, block: int = BLOCK) -> DataFrame:
    """cells with the block (bx, by) they are in; cells within `halo` of another block are repeated there (own = false).

    One shuffle on (bx, by) then serves windows along both axes, and no partition is longer than a block's side."""

    def near(v: Column) -> Column:
        return F.array_distinct(F.array(F.floor((v - halo) / block), F.floor(v / block), F.floor((v + halo) / block)))

    spread = cells.withColumn("bx", F.explode(near(F.col("x")))).withColumn("by", F.explode(near(F.col("y"))))
    own = (F.floor(F.col("x") / block) == F.col("bx")) & (F.floor(F.col("y") / block) == F.col("by"))
    return spread.withColumn("own", own).repartition("bx", "by")


def neighbourhood(cells: DataFrame, value: str = "h", block: int = BLOCK) -> DataFrame:
    """cells with n0..n8: value at (x-1, y-1), (x, y-1), ... (x+1, y+1); null where there is no such cell.

    Needs a dense raster (see extract): a cell that is not there hides its neighbours in the next rows."""
    rows = Window.partitionBy("bx", "by", "y").orderBy("x")
    cols = Window.partitionBy("bx", "by", "x").orderBy("y")
    c = in_blocks(cells, 1, block)
    left = F.when(F.lag("x").over(rows) == F.col("x") - 1, F.lag(value).over(rows))
    right = F.when(F.lead("x").over(rows) == F.col("x") + 1, F.lead(value).over(rows))
    c = c.withColumn("_row", F.struct(left.alias("a"), F.col(value).alias("b"), right.alias("c")))
    low = F.when(F.lag("y").over(cols) == F.col("y") - 1, F.lag("_row").over(cols))
    high = F.when(F.lead("y").over(cols) == F.col("y") + 1, F.lead("_row").over(cols))
    c = c.withColumn("_low", low).withColumn("_high", high).where("own")
    names = [f"{r}.{k}" for r in ("_low", "_row", "_high") for k in "abc"]
    return c.select(*cells.columns, *[F.col(n).alias(f"n{k}") for k, n in enumerate(names)])


def focal_sum(cells: DataFrame, value: str = "h") -> DataFrame:
    """(x, y, total): sum of the 3x3 neighbourhood, the centre twice; missing cells count as zero."""
    n = neighbourhood(cells, value)
    total = sum((F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(9)), F.coalesce(F.col("n4"), F.lit(0)))
    return n.select("x", "y", total.cast("long").alias("total"))


def simplify_step(cells: DataFrame) -> DataFrame:
    """One pass of majority smoothing of a 0/1 raster: a sum of 3 or less clears a cell, of 7 or more sets it."""
    n = neighbourhood(cells)
    total = sum((F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(9)), F.coalesce(F.col("n4"), F.lit(0)))
    return n.select("x", "y", F.when(total <= 3, 0).when(total >= 7, 1).otherwise(F.col("n4")).cast("int").alias("h"))


def downsample(cells: DataFrame, factor: float, width: int, height: int, min_x: int = 0, min_y: int = 0, none_as: int | None = None) -> DataFrame:
    """Area-weighted mean at any factor below 1, half to even; missing heights are left out, or count as none_as."""
    if factor == 1.0:
        return cells.select("x", "y", "h")
    w, h = int(width * factor), int(height * factor)

    def targets(v: Column, n: int) -> Column:
        return F.sequence(F.floor(v * factor).cast("int"), F.least(F.ceil((v + 1) * factor).cast("int") - 1, F.lit(n - 1)))

    local = cells.select((F.col("x") - min_x).alias("ox"), (F.col("y") - min_y).alias("oy"), F.coalesce("h", F.lit(none_as)).alias("h") if none_as is not None else F.col("h"))
    local = local.where((F.floor(F.col("ox") * factor) < w) & (F.floor(F.col("oy") * factor) < h))
    spread = local.withColumn("tx", F.explode(targets(F.col("ox"), w))).withColumn("ty", F.explode(targets(F.col("oy"), h)))

    def overlap(t: str, o: str) -> Column:
        a, b = F.col(t) / factor, (F.col(t) + 1) / factor
        return F.least(b, F.col(o) + 1.0) - F.greatest(a, F.col(o).cast("double"))

    weighed = spread.withColumn("wt", overlap("tx", "ox") * overlap("ty", "oy")).where("wt > 0")
    some = F.when(F.col("h").isNotNull(), F.col("wt"))
    mean = F.sum(F.col("h") * F.col("wt")) / F.sum(some)
    return weighed.groupBy("tx", "ty").agg(F.rint(F.round(mean, 9)).cast("int").alias("h")).select((F.col("tx") + int(min_x * factor)).alias("x"), (F.col("ty") + int(min_y * factor)).alias("y"), "h")


def level_up(cells: DataFrame) -> DataFrame:
    """2x2 reduction: mean of what is there, half to even; missing if nothing is."""
    key = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("x", "y")]
    return cells.groupBy(*key).agg(F.rint(F.avg("h")).cast("int").alias("h"))


def pyramid(cells: DataFrame, levels: int = 6) -> DataFrame:
    """(level, x, y, h) of levels 1 to `levels`, each from the one below."""
    out, now = None, cells
    for level in range(1, levels + 1):
        now = level_up(now)
        one = now.select(F.lit(level).alias("level"), "x", "y", "h")
        out = one if out is None else out.unionByName(one)
    return out


def encode_u16(h: Column) -> Column:
    return F.when(h.isNull(), 0).otherwise((h + 32768).bitwiseAND(F.lit(65535)))


def decode_u16(v: Column) -> Column:
    return F.when(v != 0, v - 32768)


def encode_water(h: Column, water: Column) -> Column:
    """h + 500 with the top bit set on water, as a signed 16-bit value; heights below -500 and flags other than 0, 1 raise."""
    ok = (h >= -500) & water.isin(0, 1)
    value = h + 500 + water * 32768
    return F.when(ok, F.when(value > 32767, value - 65536).otherwise(value)).otherwise(F.raise_error(F.concat(F.lit("cannot encode "), h.cast("string"))))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that are not the same in both: (x, y, left_h, right_h)."""
    both = a.select("x", "y", F.col("h").alias("left_h"), F.lit(1).alias("l")).join(b.select("x", "y", F.col("h").alias("right_h"), F.lit(1).alias("r")), ["x", "y"], "full")
    return both.where("l is null or r is null or not (left_h <=> right_h)").select("x", "y", "left_h", "right_h")


def zeros(spark: SparkSession, min_x: int, min_y: int, width: int, height: int) -> DataFrame:
    """A raster of height 0."""
    return canvas(spark, min_x, min_y, width, height).withColumn("h", F.lit(0))


def missing(spark: SparkSession, min_x: int, min_y: int, width: int, height: int) -> DataFrame:
    """A raster without heights."""
    return canvas(spark, min_x, min_y, width, height).withColumn("h", F.lit(None).cast("int"))


def of_sequence(values: DataFrame, min_x: int, min_y: int, width: int, height: int) -> DataFrame:
    """A raster of (pos, h): positions from 0, row by row. A number of values other than width * height raises."""
    n = values.count()
    if n != width * height:
        raise ValueError(f"{n} heights, not {width} x {height}")
    return values.select((F.col("pos") % width + min_x).cast("int").alias("x"), (F.floor(F.col("pos") / width) + min_y).cast("int").alias("y"), "h")


def pad_rim(cells: DataFrame, min_x: int, min_y: int, width: int, height: int, right: int = 1, top: int = 1) -> DataFrame:
    """cells of a rectangle and a rim of missing heights along its right and top."""
    rim = missing(cells.sparkSession, min_x, min_y, width + right, height + top)
    return cells.unionByName(rim.where((F.col("x") >= min_x + width) | (F.col("y") >= min_y + height)))


def with_heights(cells: DataFrame, new: DataFrame) -> DataFrame:
    """cells with the heights of new (x, y, h) in their place; null in new is a missing height."""
    own = new.select("x", "y", F.struct("h").alias("_new"))
    return cells.join(own, ["x", "y"], "left").select("x", "y", F.when(F.col("_new").isNotNull(), F.col("_new.h")).otherwise(F.col("h")).alias("h"))


def heights_at(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points (x, y, ...) with h; null outside the raster."""
    return points.join(cells.select("x", "y", "h"), ["x", "y"], "left")


def nearest_at(cells: DataFrame, points: DataFrame, projection: object, cells_per_degree: float) -> DataFrame:
    """points (px, py) of a map with the height h of the cell nearest to each on the ground, half to even."""
    lon, lat = projection.inverse(F.col("px").cast("double"), F.col("py").cast("double"))
    cell = points.withColumn("x", F.rint(F.degrees(lon) * cells_per_degree).cast("int")).withColumn("y", F.rint(F.degrees(lat) * cells_per_degree).cast("int"))
    return heights_at(cells, cell).drop("x", "y")


def simplify(cells: DataFrame, least_changes: int = 1, passes: int = 50) -> DataFrame:
    """simplify_step again and again, until a pass changes fewer than least_changes cells."""
    from ..storage import materialize

    now = cells.select("x", "y", F.col("h").cast("int").alias("h"))
    for _ in range(passes):
        after = materialize(simplify_step(now), "simplified")
        changed = difference(now, after).count()
        now = after
        if changed < least_changes:
            break
    return now


def decode_i16(bytes_: Column, little: bool = False) -> Column:
    """Two bytes (binary) as a signed height; the lowest value is a missing one."""
    pair = F.reverse(F.array(F.substring(bytes_, 1, 1), F.substring(bytes_, 2, 1))) if little else F.array(F.substring(bytes_, 1, 1), F.substring(bytes_, 2, 1))
    value = F.conv(F.concat(F.hex(pair[0]), F.hex(pair[1])), 16, 10).cast("int")
    signed = F.when(value >= 32768, value - 65536).otherwise(value)
    return F.nullif(signed, F.lit(-32768))


def union_mbr(rects: DataFrame) -> DataFrame:
    """(min_x, min_y, width, height) around rectangles with the same columns."""
    far = rects.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max(F.col("min_x") + F.col("width")).alias("x"), F.max(F.col("min_y") + F.col("height")).alias("y"))
    return far.select("min_x", "min_y", (F.col("x") - F.col("min_x")).alias("width"), (F.col("y") - F.col("min_y")).alias("height"))
