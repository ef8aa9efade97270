"""Map projections as pairs of Column expressions: radians to scaled map units and back; out of domain is null."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
EARTH_RADIUS = 6371000.0
INCHES_PER_METER = 39.3701
EPSILON = 1e-10
MERCATOR_MAX_LAT = 1.48442222974533


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    b: float

    @property
    def eccentricity(self) -> float:
        return math.sqrt(1 - (self.b / self.a) ** 2)


# Semi-major and semi-minor radius in metres.
ELLIPSOIDS = {"GRS80": Ellipsoid(6378137.0, 6356752.314140356), "WGS84": Ellipsoid(6378137.0, 6356752.314245179)}


@dataclass(frozen=True)
class MapScale:
    scale: float
    dpi: float

    @property
    def per_meter(self) -> float:
        return INCHES_PER_METER * self.dpi / self.scale

    @property
    def factor(self) -> float:
        """Map units of one radian on the sphere."""
        return EARTH_RADIUS / self.scale * INCHES_PER_METER * self.dpi


@dataclass(frozen=True)
class Mercator:
    factor: float = 1.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        inside = (lat >= -MERCATOR_MAX_LAT) & (lat <= MERCATOR_MAX_LAT)
        y = F.log(F.tan(F.lit(math.pi / 4) + lat / 2.0)) * self.factor
        return F.when(inside, lon * self.factor), F.when(inside, y)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x / self.factor, 2.0 * F.atan(F.exp(y / self.factor)) - math.pi / 2


def _ms(e: float, lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)


def _ts(e: float, lat: float) -> float:
    c = e * math.sin(lat)
    return math.tan((math.pi / 2 - lat) / 2) / ((1 - c) / (1 + c)) ** (e / 2)


def adjust_lon(lon: Column) -> Column:
    return F.when(F.abs(lon) < math.pi, lon).otherwise(lon - F.signum(lon) * (2 * math.pi))


@dataclass(frozen=True)
class LambertConformalConic:
    """Degrees in the parameters; constants are folded on the driver."""

    lat1: float
    lat2: float
    lat0: float = 0.0
    lon0: float = 0.0
    x0: float = 0.0
    y0: float = 0.0
    k0: float = 1.0
    ellipsoid: Ellipsoid = ELLIPSOIDS["WGS84"]
    scale: float = 1.0

    def __post_init__(self) -> None:
        if abs(self.lat1 + self.lat2) < EPSILON:
            raise ValueError("Standard parallels cannot be equal or on opposite sides of the equator.")

    def constants(self) -> dict[str, float]:
        e = self.ellipsoid.eccentricity
        a, b, o = (math.radians(x) for x in (self.lat1, self.lat2, self.lat0))
        t1 = _ts(e, a)
        n = math.log(_ms(e, a) / _ms(e, b)) / math.log(t1 / _ts(e, b)) if abs(a - b) > EPSILON else math.sin(a)
        f = _ms(e, a) / (n * t1**n)
        return {"e": e, "n": n, "f": f, "rh": self.ellipsoid.a * f * _ts(e, o) ** n, "lon0": math.radians(self.lon0), "a": self.ellipsoid.a}

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        k = self.constants()
        c = F.lit(k["e"]) * F.sin(lat)
        ts = F.tan((F.lit(math.pi / 2) - lat) * 0.5) / F.pow((1.0 - c) / (1.0 + c), F.lit(k["e"] / 2))
        r = F.lit(k["a"] * k["f"]) * F.pow(ts, F.lit(k["n"]))
        theta = F.lit(k["n"]) * adjust_lon(lon - k["lon0"])
        pole = F.abs(F.abs(lat) - math.pi / 2) <= EPSILON
        off = pole & (lat * k["n"] <= 0)
        x = F.when(off, None).when(pole, F.lit(self.k0 + self.x0)).otherwise(self.k0 * (r * F.sin(theta)) + self.x0)
        y = F.when(off, None).when(pole, F.lit(self.k0 * k["rh"] + self.y0)).otherwise(self.k0 * (k["rh"] - r * F.cos(theta)) + self.y0)
        return x * self.scale, y * self.scale

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The latitude is a fold of up to 16 steps of fixed-point iteration; null if it does not settle."""
        k = self.constants()
        xx, yy = (x / self.scale - self.x0) / self.k0, k["rh"] - (y / self.scale - self.y0) / self.k0
        sign = 1.0 if k["n"] > 0 else -1.0
        r = sign * F.sqrt(xx * xx + yy * yy)
        theta = F.when(r == 0, 0.0).otherwise(F.atan2(sign * xx, sign * yy))
        ts = F.pow(r / (k["a"] * k["f"]), F.lit(1 / k["n"]))

        def step(acc: Column, _: Column) -> Column:
            c = F.lit(k["e"]) * F.sin(acc["phi"])
            phi = F.lit(math.pi / 2) - 2.0 * F.atan(acc["ts"] * F.pow((1.0 - c) / (1.0 + c), F.lit(k["e"] / 2)))
            return F.when(acc["done"], acc).otherwise(F.struct(phi.alias("phi"), (F.abs(phi - acc["phi"]) < EPSILON).alias("done"), acc["ts"].alias("ts")))

        first = F.struct((F.lit(math.pi / 2) - 2.0 * F.atan(ts)).alias("phi"), F.lit(False).alias("done"), ts.alias("ts"))
        last = F.aggregate(F.sequence(F.lit(0), F.lit(15)), first, step)
        return adjust_lon(theta / k["n"] + k["lon0"]), F.when(last["done"], last["phi"])


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points given in radians."""
    a = F.sin((lat2 - lat1) / 2.0), F.sin((lon2 - lon1) / 2.0)
    h = a[0] * a[0] + F.cos(lat1) * F.cos(lat2) * a[1] * a[1]
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def level_needed(delta_degrees: Column, tile_size: int, max_level: int = 6) -> Column:
    """Pyramid level whose cells are no larger than the delta."""
    return F.least(F.lit(max_level), F.greatest(F.lit(0), F.log2(delta_degrees * tile_size).cast("int")))


def lon_lat_delta(projection: Mercator | LambertConformalConic, x: Column, y: Column) -> Column:
    """Radians that one map unit to the north east spans at (x, y): the lesser of longitude and latitude. Where a place is off the
    map, the largest double."""
    a, b = projection.inverse(x, y), projection.inverse(x + 1, y + 1)
    d = F.least(F.abs(b[0] - a[0]), F.abs(b[1] - a[1]))
    known = a[0].isNotNull() & a[1].isNotNull() & b[0].isNotNull() & b[1].isNotNull()
    return F.when(known, d).otherwise(F.lit(1.7976931348623157e308))


def projected_mbr(points: DataFrame, projection: Mercator | LambertConformalConic, *by: str) -> DataFrame:
    """(by, min_x, min_y, max_x, max_y) in whole map units around points (lon, lat in degrees); points off the map are left out."""
    x, y = projection.forward(F.col("lon") * (math.pi / 180), F.col("lat") * (math.pi / 180))
    p = points.select(*by, x.alias("px"), y.alias("py")).where("px is not null and py is not null")
    return p.groupBy(*by).agg(F.floor(F.min("px")).cast("int").alias("min_x"), F.floor(F.round(F.min("py"), 6)).cast("int").alias("min_y"), F.ceil(F.max("px")).cast("int").alias("max_x"), F.ceil(F.round(F.max("py"), 6)).cast("int").alias("max_y"))


def geo_mbr(rects: DataFrame, projection: Mercator | LambertConformalConic, key: str) -> DataFrame:
    """(key, min_lon, min_lat, max_lon, max_lat in radians) around map rectangles (key, min_x, min_y, max_x, max_y), from their
    corners and the middles of their sides; rectangles of which one of these is off the map are left out."""
    mid = {a: [F.col(f"min_{a}"), (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2, F.col(f"max_{a}")] for a in "xy"}
    border = F.array(*[F.struct(x.cast("double").alias("px"), y.cast("double").alias("py")) for i, x in enumerate(mid["x"]) for j, y in enumerate(mid["y"]) if (i, j) != (1, 1)])
    lon, lat = projection.inverse(F.col("px"), F.col("py"))
    on = rects.select(key, F.inline(border)).select(key, lon.alias("lon"), lat.alias("lat"))
    found = on.groupBy(key).agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"), F.count_if(F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("n"))
    return found.where("n = 8").drop("n")
