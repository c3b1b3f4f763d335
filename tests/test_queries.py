"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from murmuration.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return tuple(plain(x) for x in value) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{data}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    if name in SQL:
        found = duck.sql(SQL[name])
        places = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns
        assert rows == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)


def test_names_are_complete():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 93
