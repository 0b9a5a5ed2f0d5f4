"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os
from datetime import timezone

import pytest

from threadloom.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if getattr(v, "tzinfo", None) is not None:
        return v.astimezone(timezone.utc).replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(DATA + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        return
    q = duck.sql(registry.SQL[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=repr)
