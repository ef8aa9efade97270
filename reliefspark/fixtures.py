"""Rasters, points, colours and shapes derived from business tables, by SQL that Spark and DuckDB read alike.

The raster engine is tried on tables that hold no rasters; every derivation uses all rows of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dem_sql(n: int = 64) -> str:
    return f"""SELECT CAST(l_partkey % {n} AS INT) AS x, CAST(l_orderkey % {n} AS INT) AS y,
    CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 17 = 0 THEN NULL
    ELSE CAST((CAST(sum(l_quantity) AS BIGINT) * 37 + (l_partkey % {n}) * 11 + (l_orderkey % {n}) * 7) % 3000 - 100 AS INT) END AS h
    FROM lineitem GROUP BY l_partkey % {n}, l_orderkey % {n}"""


def parts_sql(n: int = 64) -> str:
    return f"""SELECT CAST(l_linenumber AS INT) AS src_ord, CAST(l_partkey % {n} AS INT) AS x, CAST(l_orderkey % {n} AS INT) AS y,
    CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 7 = 0 THEN NULL ELSE CAST(CAST(sum(l_quantity) AS BIGINT) % 900 AS INT) END AS h
    FROM lineitem GROUP BY l_linenumber, l_partkey % {n}, l_orderkey % {n}"""


def cover_sql(n: int = 64) -> str:
    return f"""SELECT CAST(l_partkey % {n} AS INT) AS x, CAST(l_orderkey % {n} AS INT) AS y,
    CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 5 < 3 THEN 80 ELSE 10 END AS h
    FROM lineitem GROUP BY l_partkey % {n}, l_orderkey % {n}"""


POINTS = """SELECT o_orderkey AS id, CAST(o_orderkey * 7919 % 360000 AS DOUBLE) / 1000 - 180 AS lon,
    CAST(o_orderkey * 104729 % 160000 AS DOUBLE) / 1000 - 80 AS lat, CAST(o_orderkey % 7 AS INT) AS level FROM orders"""

COLORS = """SELECT l_orderkey * 8 + l_linenumber AS id, (l_partkey % 256) * 16777216 + (l_suppkey % 256) * 65536 + (l_orderkey % 256) * 256
    + CASE WHEN l_linenumber = 1 THEN 255 WHEN l_linenumber = 2 THEN 0 ELSE CAST(l_quantity * 5 AS BIGINT) % 256 END AS c1,
    (l_orderkey * 7 % 256) * 16777216 + (l_partkey * 3 % 256) * 65536 + (l_suppkey * 5 % 256) * 256
    + CASE WHEN l_orderkey % 5 = 0 THEN 255 WHEN l_orderkey % 5 = 1 THEN 0 ELSE CAST(l_quantity * 3 AS BIGINT) % 256 END AS c2,
    CAST(l_partkey % 11 AS DOUBLE) / 10 AS ratio FROM lineitem"""

STENCILS = "SELECT l_orderkey * 8 + l_linenumber AS id, " + ", ".join(f"CAST((l_partkey * {k * 31 + 7} + l_orderkey * {k * 17 + 3} + l_suppkey * {k + 1}) % 2000 AS DOUBLE) AS h{k}" for k in range(9)) + ", 30.0 + CAST(l_linenumber AS DOUBLE) AS w, 31.0 AS hgt FROM lineitem"

TILES = """SELECT n_nationkey AS id, CAST(n_regionkey AS INT) AS level, CAST((n_nationkey * 37) % 120 - 60 AS INT) AS tile_x,
    CAST((n_nationkey * 53) % 100 - 50 AS INT) AS tile_y FROM nation"""

BOUNDS = """SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS level, CAST(o_custkey % 300 - 150 AS DOUBLE) + 0.1 AS min_lon,
    CAST(o_orderkey % 120 - 60 AS DOUBLE) + 0.3 AS min_lat, CAST(o_custkey % 300 - 150 AS DOUBLE) + 0.1 + (o_orderkey % 5) * 0.9 AS max_lon,
    CAST(o_orderkey % 120 - 60 AS DOUBLE) + 0.3 + (o_custkey % 4) * 1.1 AS max_lat FROM orders"""

INTERVALS = "SELECT o_orderkey AS id, o_custkey * 40 + o_orderkey % 40 AS low, o_custkey * 40 + o_orderkey % 40 + o_orderkey % 50 AS high FROM orders"

RECTS = """SELECT o_orderkey AS id, o_custkey * 20 AS min_x, (o_orderkey * 13) % 1000 AS min_y, o_orderkey % 30 AS width, o_custkey % 25 AS height FROM orders"""

SEGMENTS = """SELECT c_custkey AS id, CAST(c_custkey % 10 AS DOUBLE) AS x1, CAST(c_custkey * 3 % 8 AS DOUBLE) AS y1,
    CAST((c_custkey + c_custkey % 4) % 10 AS DOUBLE) AS x2, CAST((c_custkey * 3 + c_custkey % 5) % 8 AS DOUBLE) AS y2,
    CAST(c_custkey * 7 % 10 AS DOUBLE) AS x3, CAST(c_custkey * 5 % 8 AS DOUBLE) AS y3,
    CAST(CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 10 ELSE c_custkey * 11 % 10 END AS DOUBLE) AS x4,
    CAST(CASE WHEN c_custkey % 6 = 0 THEN c_custkey * 3 % 8 ELSE c_custkey * 13 % 8 END AS DOUBLE) AS y4 FROM customer"""

VERTICES = """SELECT c_nationkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord,
    CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 1000 AS DOUBLE) AS y FROM customer"""

ANGLES = "SELECT user_id, value * 3.141592653589793 / 180.0 AS a, value * 2.5 AS deg FROM events"

MOVES = """SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord,
    CASE event_type WHEN 'click' THEN 'N' WHEN 'view' THEN 'E' WHEN 'purchase' THEN 'SW' ELSE 'NW' END AS dir FROM events"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation of a derivation over the tables of a folder."""
    import re

    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    named = sql
    for t in used:
        named = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", named)
    return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
