"""Every oracle query at the smallest scale against DuckDB."""

import math
import os

import duckdb
import pytest

from cityloom.plans import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"simulate", "forecast_regression", "kmeans_clusters"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert len(rows) == len(want)
    assert all(_same(x, y) for r, w in zip(rows, want) for x, y in zip(r, w))
