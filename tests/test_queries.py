"""Every query with SQL gives the rows of its SQL."""

from __future__ import annotations

import os

import pytest

from veldt.queries import QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def spelled(rows):
    return sorted(tuple("0.0" if isinstance(x, float) and x == 0 else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if not q.sql:
        assert got
        return
    ran = duck.execute(q.sql)
    names = [x[0] for x in ran.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == cols
    assert spelled(got) == spelled(tuple(r[i] for i in order) for r in ran.fetchall())
