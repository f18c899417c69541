"""Every registered query against its SQL, on the smallest tables if they are there."""

import glob
import math
import os

import pytest

from faultlens.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name not in registry.SQL:
        assert rows
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    r = con.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(v[names.index(c)]) for c in columns) for v in r.fetchall())
