"""Every registered query of the engine against its SQL on the smallest data set."""

import math
from collections import Counter
from pathlib import Path

import pytest

from pathquill import queries as registered

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no data")


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return str(x) if type(x).__name__ in ("datetime", "Timestamp") else x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registered.queries()))
@pytest.mark.filterwarnings("ignore:'and' after")
def test_query(spark, duck, name):
    df = registered.queries()[name](spark, str(DATA))
    got = df.collect()
    rel = duck.sql(registered.oracle_sql()[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    wanted = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got) == wanted
