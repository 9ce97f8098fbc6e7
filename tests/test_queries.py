"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
#: Rows only: no SQL expresses them.
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        return got, None
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    return got, want


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got, want = rows_of(spark, duck, name)
    assert want is None or got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
