"""Segments, polygons, rectangles and interval joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arith import value_01_status
from ..storage import materialize

Point = tuple[Column, Column]


def area2(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area of a triangle."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


def side(area: Column, tolerance: float) -> Column:
    return F.when(F.abs(area) <= tolerance, "collinear").when(area > 0, "left").otherwise("right")


def _between(s: Column, a: Point, b: Point, c: Point) -> Column:
    def inside(k: int) -> Column:
        return ((a[k] <= c[k]) & (c[k] <= b[k])) | ((a[k] >= c[k]) & (c[k] >= b[k]))

    return (s == "collinear") & F.when(a[0] != b[0], inside(0)).otherwise(inside(1))


def _same(a: Point, b: Point) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1])


def intersection_class(p1: Point, p2: Point, p3: Point, p4: Point, tolerance: float = 1e-4) -> Column:
    """How segments p1-p2 and p3-p4 meet, in eight classes."""
    s3, s4, s1, s2 = (side(a, tolerance) for a in (area2(p1, p2, p3), area2(p1, p2, p4), area2(p3, p4, p1), area2(p3, p4, p2)))
    none_collinear = (s1 != "collinear") & (s2 != "collinear") & (s3 != "collinear") & (s4 != "collinear")
    proper = none_collinear & (s3 != s4) & (s1 != s2)

    def pair(a: Point, b: Point, c: Point, d: Point, sc: Column, sd: Column) -> Column:
        on_c, on_d = _between(sc, a, b, c), _between(sd, a, b, d)
        flat = F.when(on_c & on_d, True).when(on_c, sd == "collinear").when(on_d, sc == "collinear")
        return F.when(~on_c & ~on_d, "none").when(flat, "overlap").otherwise("touch")

    m34, m12 = pair(p1, p2, p3, p4, s3, s4), pair(p3, p4, p1, p2, s1, s2)
    met = F.when((m34 == "overlap") | (m12 == "overlap"), "CollinearOverlapping").when((m34 == "touch") & (m12 == "touch"), "SharingOneEndpoint").when((m34 == "touch") | (m12 == "touch"), "OneEndpointLiesOnOtherSegment").otherwise("NotIntersect")
    v13, v24, v14, v23 = _same(p1, p3), _same(p2, p4), _same(p1, p4), _same(p2, p3)
    return (
        F.when(_same(p1, p2) | _same(p3, p4), "OneOrBothAreZeroLength").when(v13 & v24, "Same").when(v14 & v23, "Opposite").when(v13 | v24 | v14 | v23, "SharingOneEndpoint").when(proper, "IntersectProperly").otherwise(met)
    )


def intersection_point(p1: Point, p2: Point, p3: Point, p4: Point, tolerance: float = 1e-4) -> tuple[Column, Column, Column]:
    """Class in six kinds, and the point (null if there is none)."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = p1, p2, p3, p4
    denom = x1 * (y4 - y3) + x2 * (y3 - y4) + x4 * (y2 - y1) + x3 * (y1 - y2)
    s = (x1 * (y4 - y3) + x3 * (y1 - y4) + x4 * (y3 - y1)) / F.when(denom != 0, denom)
    t = -(x1 * (y3 - y2) + x2 * (y1 - y3) + x3 * (y2 - y1)) / F.when(denom != 0, denom)
    ss, tt = value_01_status(s, tolerance), value_01_status(t, tolerance)
    end_s, end_t, in_s, in_t = ss.isin("zero", "one"), tt.isin("zero", "one"), ss == "between", tt == "between"
    crossing = F.when(end_s & end_t, "SharingOneEndpoint").when((end_s & in_t) | (in_s & end_t), "OneEndpointLiesOnOtherSegment").when(in_s & in_t, "IntersectProperly").otherwise("DoNotIntersect")
    flat = side(area2(p1, p2, p3), tolerance) == "collinear"
    yes = F.lit("collinear")
    on = [(p3, _between(yes, p1, p2, p3)), (p4, _between(yes, p1, p2, p4)), (p1, _between(yes, p3, p4, p1)), (p2, _between(yes, p3, p4, p2))]
    same = (_same(p1, p3) & _same(p2, p4)) | (_same(p1, p4) & _same(p2, p3))
    at3, at4 = _same(p1, p3) | _same(p2, p3), _same(p1, p4) | _same(p2, p4)
    touches = on[0][1] | on[1][1] | on[2][1] | on[3][1]
    parallel = F.when(same, "CollinearOverlapping").when(at3 | at4, "SharingOneEndpoint").when(flat & touches, "CollinearOverlapping").otherwise("DoNotIntersect")

    def parallel_at(k: int) -> Column:
        out = F.when(same, p1[k]).when(at3, p3[k]).when(at4, p4[k])
        for p, yes_ in on:
            out = out.when(flat & yes_, p[k])
        return out

    zero, is_parallel = _same(p1, p2) | _same(p3, p4), F.abs(denom) <= tolerance
    kind = F.when(zero, "OneOrBothAreZeroLength").when(is_parallel, parallel).otherwise(crossing)
    met = crossing != "DoNotIntersect"
    x = F.when(zero, None).when(is_parallel, parallel_at(0)).when(met, x1 + s * (x2 - x1))
    y = F.when(zero, None).when(is_parallel, parallel_at(1)).when(met, y1 + s * (y2 - y1))
    return kind, x, y


def interval_join(a: DataFrame, b: DataFrame, width: int, low: str = "low", high: str = "high") -> DataFrame:
    """Pairs of closed intervals that overlap: (a_id, b_id).

    Both sides are dealt into buckets of `width`, joined by bucket, and a pair is kept in the first bucket it shares, so
    the join is by equality and no interval is compared with one far away."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        lo, hi = F.col(low), F.col(high)
        buckets = F.sequence(F.floor(lo / width), F.floor(hi / width))
        return df.where(hi >= lo).select(F.col("id").alias(f"{p}_id"), lo.alias(f"{p}_low"), hi.alias(f"{p}_high"), F.explode(buckets).alias("bucket"))

    both = dealt(a, "a").join(dealt(b, "b"), "bucket").where("a_low <= b_high and a_high >= b_low")
    return both.where(F.col("bucket") == F.floor(F.greatest("a_low", "b_low") / width)).select("a_id", "b_id")


def rect_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of rectangles (id, min_x, min_y, width, height) that touch or overlap; dealt by buckets along x."""
    ends = lambda df: df.withColumn("low", F.col("min_x")).withColumn("high", F.col("min_x") + F.col("width"))
    pairs = interval_join(ends(a), ends(b), width)
    ya = a.select(F.col("id").alias("a_id"), F.col("min_y").alias("a0"), (F.col("min_y") + F.col("height")).alias("a1"))
    yb = b.select(F.col("id").alias("b_id"), F.col("min_y").alias("b0"), (F.col("min_y") + F.col("height")).alias("b1"))
    return pairs.join(ya, "a_id").join(yb, "b_id").where("a0 <= b1 and a1 >= b0").select("a_id", "b_id")


def polygon_edges(points: DataFrame) -> DataFrame:
    """(id, edge, x1, y1, x2, y2) of vertices (id, ord, x, y), the closing edge too, without edges of no length."""
    w = Window.partitionBy("id").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y")]
    e = points.select("id", "ord", F.col("x").alias("x1"), F.col("y").alias("y1"), after[0].alias("x2"), after[1].alias("y2")).where("x1 <> x2 or y1 <> y2")
    return e.select("id", (F.row_number().over(w) - 1).alias("edge"), "x1", "y1", "x2", "y2")


#: Edges of a polygon that one row holds, and of them those that are tried against another row's at once.
BLOCK_EDGES, TILE_EDGES = 4096, 32


@dataclass
class _Edges:
    """Consecutive edges (edge: the first one's number) of a polygon. xs, ys, gone: their points and which of them have a null; starts
    and ends are slices of these, and where each edge begins at the end of the one before, such points stand once."""

    edge: int
    xs: np.ndarray
    ys: np.ndarray
    gone: np.ndarray | None
    starts: slice
    ends: slice
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(edge: int, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, gone: np.ndarray | None) -> _Edges:
        n = len(x1)
        low, high = np.fmin(y1, y2), np.maximum(y1, y2)
        if gone is not None:  # a null is passed over; other missing numbers are above all
            null1, null2 = gone[:, 1], gone[:, 3]
            low, high = np.where(null1, y2, np.where(null2, y1, low)), np.where(null1, y2, np.where(null2, y1, high))
        low, high = np.where(np.isnan(low), np.inf, low), np.where(np.isnan(high), np.inf, high)
        if gone is not None:
            high[null1 & null2] = -np.inf
        elif np.array_equal(x1[1:], x2[:-1]) and np.array_equal(y1[1:], y2[:-1]):
            return _Edges(edge, np.append(x1, x2[-1:]), np.append(y1, y2[-1:]), None, slice(0, n), slice(1, n + 1), low, high)
        points_gone = None if gone is None else np.concatenate([gone[:, 0] | gone[:, 1], gone[:, 2] | gone[:, 3]])
        return _Edges(edge, np.append(x1, x2), np.append(y1, y2), points_gone, slice(0, n), slice(n, 2 * n), low, high)

    def __len__(self) -> int:
        return len(self.low)

    def part(self, lo: int, hi: int) -> _Edges:
        at, n = (slice(lo, hi + 1), hi - lo) if self.ends.start == 1 else (np.r_[lo:hi, len(self) + lo : len(self) + hi], hi - lo)
        starts, ends = slice(0, n), slice(1, n + 1) if self.ends.start == 1 else slice(n, 2 * n)
        return _Edges(self.edge + lo, self.xs[at], self.ys[at], None if self.gone is None else self.gone[at], starts, ends, self.low[lo:hi], self.high[lo:hi])

    def areas(self, other: _Edges, as_rows: bool) -> np.ndarray:
        """area2 of each edge and each point of other; edges are rows or columns. Where a null takes part: below all."""
        turn = (lambda v: v[:, None]) if as_rows else (lambda v: v[None, :])
        across = (lambda v: v[None, :]) if as_rows else (lambda v: v[:, None])
        x, y = self.xs[self.starts], self.ys[self.starts]
        out = turn(self.xs[self.ends] - x) * (across(other.ys) - turn(y))
        out -= (across(other.xs) - turn(x)) * turn(self.ys[self.ends] - y)
        for gone in (None if self.gone is None else turn(self.gone[self.starts] | self.gone[self.ends]), None if other.gone is None else across(other.gone)):
            if gone is not None:
                out[np.broadcast_to(gone, out.shape)] = -np.inf
        return out


def _between_all(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of points a, b, c: c is within a and b, by x where these differ, else by y."""
    inside = lambda a, b, c: ((a <= c) & (c <= b)) | ((a >= c) & (c >= b))
    return np.where(x[0] != x[1], inside(*x), inside(*y))


def _shared(a: _Edges, b: _Edges) -> np.ndarray:
    """Which edges of a (rows) share an end with which of b."""
    return reduce(np.logical_or, [(a.xs[s][:, None] == b.xs[t]) & (a.ys[s][:, None] == b.ys[t]) for s in (a.starts, a.ends) for t in (b.starts, b.ends)])


def _meeting(a: _Edges, b: _Edges, edges: int, tolerance: float) -> int:
    """Pairs of an edge of a and a later one of b, no neighbours in a polygon of so many edges, whose class is not NotIntersect: they
    cross, or share an end, or an end of one that is collinear with the other lies between its ends (see intersection_class)."""
    found = 0
    if not (a.low.min() <= b.high.max() and a.high.max() >= b.low.min()):
        return 0
    for lo in range(0, len(a), TILE_EDGES):
        t = a.part(lo, min(lo + TILE_EDGES, len(a)))
        o = b if a.edge != b.edge else b.part(lo, len(b))
        near = (t.low[:, None] <= o.high) & (t.high[:, None] >= o.low)
        if not o.edge - (t.edge + len(t) - 1) > 1:
            near &= np.arange(o.edge, o.edge + len(o)) - np.arange(t.edge, t.edge + len(t))[:, None] > 1
        if t.edge == 0 and o.edge + len(o) == edges:
            near[0, -1] = False
        # points of o beside edges of t, and points of t beside edges of o; not a number counts as left
        one, two = t.areas(o, True), o.areas(t, False)
        right1, right2 = one < -tolerance, two < -tolerance
        left1, left2 = ~(one <= tolerance), ~(two <= tolerance)
        cross = (left1[:, o.starts] & right1[:, o.ends]) | (right1[:, o.starts] & left1[:, o.ends])
        cross &= (left2[t.starts] & right2[t.ends]) | (right2[t.starts] & left2[t.ends])
        cross &= near
        found += int(np.count_nonzero(cross))
        flat1, flat2 = ~(left1 | right1), ~(left2 | right2)
        flat = flat1[:, o.starts] | flat1[:, o.ends] | flat2[t.starts] | flat2[t.ends]
        if t.gone is not None or o.gone is not None:  # else points of both are collinear with either
            flat |= _shared(t, o)
        near &= flat & ~cross
        r, c = np.nonzero(near)
        if len(r):
            (x1, y1, x2, y2), (x3, y3, x4, y4) = ((e.xs[e.starts][k], e.ys[e.starts][k], e.xs[e.ends][k], e.ys[e.ends][k]) for e, k in ((t, r), (o, c)))
            meet = flat1[:, o.starts][r, c] & _between_all((x1, x2, x3), (y1, y2, y3)) | flat1[:, o.ends][r, c] & _between_all((x1, x2, x4), (y1, y2, y4))
            meet |= flat2[t.starts][r, c] & _between_all((x3, x4, x1), (y3, y4, y1)) | flat2[t.ends][r, c] & _between_all((x3, x4, x2), (y3, y4, y2))
            for p in ((x1, y1), (x2, y2)):
                for q in ((x3, y3), (x4, y4)):
                    meet |= (p[0] == q[0]) & (p[1] == q[1])
            found += int(np.count_nonzero(meet))
    return found


def self_intersecting(points: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(id, edges, crossings): pairs of edges that are no neighbours and meet. Edges meet only if their y ranges overlap.

    The edges of a polygon lie in rows of BLOCK_EDGES, and each two rows are tried by themselves, so that no row is made for a pair
    and one large polygon is dealt over many tasks."""
    e = polygon_edges(points)
    ends = [F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")]
    rows = F.sort_array(F.collect_list(F.struct(F.col("edge").cast("int"), *ends)))
    blocks = materialize(e.groupBy("id", F.floor(F.col("edge") / BLOCK_EDGES).cast("int").alias("block")).agg(rows.alias("rows")), "edges")
    n = blocks.groupBy("id").agg(F.sum(F.size("rows").cast("long")).alias("edges"), F.max("block").alias("last"))
    left = blocks.join(n, "id").select("id", "edges", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.col("rows").alias("a"))
    right = blocks.select("id", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("b"))

    def edges_of(column: pa.ListArray) -> Iterator[_Edges]:
        flat, at = column.flatten(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
        first = flat.field(0).to_numpy()
        gone = np.column_stack([flat.field(k).is_null().to_numpy(zero_copy_only=False) for k in range(1, 5)])
        xy = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(1, 5)]
        for lo, hi in zip(at, at[1:], strict=False):
            yield _Edges.of(int(first[lo]), *[v[lo:hi] for v in xy], gone[lo:hi] if gone[lo:hi].any() or not all(np.isfinite(v[lo:hi]).all() for v in xy) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for b in batches:
                met = [_meeting(x, y, k, tolerance) for x, y, k in zip(edges_of(b.column(2)), edges_of(b.column(3)), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(met, pa.int64())], ["id", "met"])

    id_type = points.schema["id"].dataType.simpleString()
    met = left.join(right, ["id", "i", "j"]).select("id", "edges", "a", "b").mapInArrow(run, f"id {id_type}, met long").groupBy("id").agg(F.sum("met").alias("crossings"))
    return n.join(met, "id", "left").select("id", "edges", F.coalesce("crossings", F.lit(0)).alias("crossings"))


def triangle_normal(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> list[Column]:
    """Unit normal; null for a triangle without area."""
    u, v = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return [F.when(length > 0, x / length) for x in n]


def midpoint(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def length(a: Point, b: Point) -> Column:
    return F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))


def extended(a: Point, b: Point, before: Column | float, after: Column | float) -> tuple[Point, Point]:
    """The segment made longer by so much at either end; a point stays a point."""
    n = length(a, b)
    ux, uy = (F.when(n > 0, (b[k] - a[k]) / n).otherwise(0.0) for k in (0, 1))
    return (a[0] - ux * before, a[1] - uy * before), (b[0] + ux * after, b[1] + uy * after)


def segment_kind(a: Point, b: Point) -> Column:
    """point, horizontal, vertical or sloped."""
    return F.when((a[0] == b[0]) & (a[1] == b[1]), "point").when(a[1] == b[1], "horizontal").when(a[0] == b[0], "vertical").otherwise("sloped")


def points_of(flat: Column) -> Column:
    """Array of (x, y) of an array x, y, x, y ...; a number left over gives a null."""
    xs, ys = F.filter(flat, lambda v, i: i % 2 == 0), F.filter(flat, lambda v, i: i % 2 == 1)
    return F.when(F.size(flat) % 2 == 0, F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))


def inflate(min_x: Column, min_y: Column, width: Column, height: Column, by: int) -> tuple[Column, Column, Column, Column]:
    return min_x - by, min_y - by, width + 2 * by, height + 2 * by


def mbr(points: DataFrame, *by: str, x: str = "lon", y: str = "lat") -> DataFrame:
    return points.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
