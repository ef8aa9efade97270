"""Every registered query of the raster engine against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from reliefspark import queries as Q

SF = "/root/testdata/sf0.001"


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted("|".join(map(text, r)) for r in df.select(*cols).collect())
    r = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(k) for k in cols]
    assert ours == sorted("|".join(text(x[i]) for i in at) for x in r.fetchall())
