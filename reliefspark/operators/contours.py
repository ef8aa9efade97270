"""Isolines: edges between cells, steps along them, run-length moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Step (axis, direction), and the directions tried next, in order, with the axis and shift of the next edge.
NEXT = (
    ("v", "up", (("h", "left", 0, -1), ("v", "up", 0, -1), ("h", "right", 1, -1))),
    ("h", "right", (("v", "up", 0, 0), ("h", "right", 1, 0), ("v", "down", 0, 1))),
    ("v", "down", (("h", "right", 1, 0), ("v", "down", 0, 1), ("h", "left", 0, 0))),
    ("h", "left", (("v", "down", -1, 1), ("h", "left", -1, 0), ("v", "up", -1, 0))),
)


def contour_edges(cells: DataFrame, level: float) -> DataFrame:
    """(axis, x, y, dir): edges between a cell and the next one in y (h) or in x (v) that the level passes."""
    x, y = Window.partitionBy("x").orderBy("y"), Window.partitionBy("y").orderBy("x")
    after_y = F.when(F.lead("y").over(x) == F.col("y") + 1, F.lead("h").over(x))
    after_x = F.when(F.lead("x").over(y) == F.col("x") + 1, F.lead("h").over(y))
    both = cells.withColumn("ny", after_y).withColumn("nx", after_x)

    def crossing(n: str, up: str, down: str):
        return F.when((F.col("h") <= level) & (F.col(n) > level), up).when((F.col("h") > level) & (F.col(n) <= level), down)

    edges = F.array(F.struct(F.lit("h").alias("axis"), crossing("ny", "right", "left").alias("dir")), F.struct(F.lit("v").alias("axis"), crossing("nx", "up", "down").alias("dir")))
    return both.select("x", "y", F.inline(edges)).where("dir is not null").select("axis", "x", "y", "dir")


def next_steps(edges: DataFrame) -> DataFrame:
    """Each edge with the first edge that may follow it: (axis, x, y, dir, next_axis, next_x, next_y, next_dir); null at the rim."""
    rules = [(a, d, k, na, nd, dx, dy) for a, d, ways in NEXT for k, (na, nd, dx, dy) in enumerate(ways)]
    table = edges.sparkSession.createDataFrame(rules, "axis string, dir string, rank int, next_axis string, next_dir string, dx int, dy int")
    tried = edges.join(F.broadcast(table), ["axis", "dir"]).withColumn("next_x", F.col("x") + F.col("dx")).withColumn("next_y", F.col("y") + F.col("dy"))
    there = edges.select(F.col("axis").alias("next_axis"), F.col("x").alias("next_x"), F.col("y").alias("next_y"), F.col("dir").alias("next_dir"))
    found = tried.join(there, there.columns)
    first = found.groupBy("axis", "x", "y", "dir").agg(F.min(F.struct("rank", "next_axis", "next_x", "next_y", "next_dir")).alias("n"))
    named = first.select("axis", "x", "y", "dir", "n.next_axis", "n.next_x", "n.next_y", "n.next_dir")
    return edges.join(named, ["axis", "x", "y", "dir"], "left")


def isolines(cells: DataFrame, level: float) -> DataFrame:
    """(isoline, closed, axis, x, y, dir): steps with the smallest step of their line as its name, by pointer jumping along
    next_steps. At saddles where two lines want one edge, both keep their own successor and count as one line."""
    key = F.concat_ws(":", "axis", "x", "y", "dir")
    nxt = F.when(F.col("next_axis").isNotNull(), F.concat_ws(":", "next_axis", "next_x", "next_y", "next_dir"))
    steps = next_steps(contour_edges(cells, level)).withColumn("key", key).withColumn("nxt", nxt).persist()
    from .water import smallest_reachable

    ids = steps.select("key", F.xxhash64("key").alias("id"), F.xxhash64("nxt").alias("nid"), "nxt")
    pairs = ids.select(F.col("id").alias("a"), F.when(F.col("nxt").isNull(), F.col("id")).otherwise(F.col("nid")).alias("b"))
    roots = smallest_reachable(pairs)
    named = steps.join(ids.select("key", "id"), "key").join(roots, F.col("id") == roots["node"])
    ends = named.groupBy("root").agg(F.max(F.col("nxt").isNull()).alias("open"), F.min("key").alias("isoline"))
    return named.join(ends, "root").select("isoline", (~F.col("open")).alias("closed"), "axis", "x", "y", "dir")


def runs(steps: DataFrame) -> DataFrame:
    """Run-length moves of (id, ord, dir): (id, run, dir, cnt), gaps and islands."""
    by, own = Window.partitionBy("id").orderBy("ord"), Window.partitionBy("id", "dir").orderBy("ord")
    g = steps.withColumn("island", F.row_number().over(by) - F.row_number().over(own))
    out = g.groupBy("id", "dir", "island").agg(F.count("*").alias("cnt"), F.min("ord").alias("first"))
    return out.select("id", F.row_number().over(Window.partitionBy("id").orderBy("first")).alias("run"), "dir", "cnt")


# The way of each move.
WAYS = {"N": (0, -1), "NE": (1, -1), "E": (1, 0), "SE": (1, 1), "S": (0, 1), "SW": (-1, 1), "W": (-1, 0), "NW": (-1, -1)}


def walk(moves: DataFrame) -> DataFrame:
    """(id, step, x, y) of moves (id, run, dir, cnt) from the origin: expanded, then summed up."""
    table = moves.sparkSession.createDataFrame([(k, *v) for k, v in WAYS.items()], "dir string, dx int, dy int")
    one = moves.join(F.broadcast(table), "dir").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))))
    w = Window.partitionBy("id").orderBy("run", "k")
    sums = w.rowsBetween(Window.unboundedPreceding, 0)
    return one.select("id", F.row_number().over(w).alias("step"), F.sum("dx").over(sums).alias("x"), F.sum("dy").over(sums).alias("y"))
