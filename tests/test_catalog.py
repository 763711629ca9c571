"""Every registered flow query that has SQL, against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from netquarry import catalog, inspection, sessions  # noqa: F401  (the last two add their queries to the catalog)

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    wanted = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert ordered(found.collect(), found.columns) == ordered(wanted.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
