"""Every query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_
from millrace.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{Path(sf) / t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = entry_.queries()[name](spark, sf)
    data = [tuple(r) for r in got.collect()]
    if name not in catalog.SQL:
        assert data
        return
    result = db.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, data) == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry_.entry(spark).count()
    assert set(entry_.oracle_sql()) <= set(entry_.queries())
