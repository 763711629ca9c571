"""Registered queries of this subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from netquarry.llm import queries

from ..test_catalog import FOLDER, TABLES, ordered


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = queries.queries()[name](spark, FOLDER)
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert ordered(found.collect(), found.columns) == ordered(wanted.fetchall(), columns)
