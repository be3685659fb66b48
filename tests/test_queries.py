"""Every registered query of the engine against its SQL on the small tables."""

from __future__ import annotations

import collections
import glob
import os

import pytest

from kilnworks.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows and not any(all(v is None for v in r) for r in rows)
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = [df.columns.index(c) for c in names]
    got = collections.Counter(plain(tuple(r[i] for i in at)) for r in rows)
    assert got == collections.Counter(map(plain, want))


def test_sql_belongs_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
