"""Queries on keys beyond those of the small tables, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from netquarry import catalog, inspection  # noqa: F401  (it adds its queries to the catalog)
from netquarry.functions import net

from .test_catalog import ordered


def equal(spark, folder, name):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    wanted = con.execute(catalog.SQL[name])
    columns = [c[0] for c in wanted.description]
    found = catalog.QUERIES[name](spark, str(folder))
    return ordered(found.collect(), found.columns) == ordered(wanted.fetchall(), columns)


@pytest.mark.parametrize("name", ["pr6_decoded", "fl1_ingest"])
def test_ports_beyond_16_bits(spark, tmp_path, name):
    u = F.col("user_id")
    user = F.when(u % 3 == 0, u).when(u % 3 == 1, u + 25530).otherwise(u * 1_000_003)
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", user).write.parquet(f"{tmp_path}/events.parquet")
    assert equal(spark, tmp_path, name)


def test_ties_go_to_even(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 5").withColumn("event_id", F.col("event_id") + 547422).write.parquet(f"{tmp_path}/events.parquet")
    assert equal(spark, tmp_path, "sf14_formats")


def test_text_of_exact_values(spark):
    ties = [k / 8 + n for k in range(8) for n in (1, 2, 999)] + [1.005, 1.995, 1.9951, 9.995, 1023.995, 0.05, 0.15, 0.25, 0.35, 0.95, 2.0**40 + 0.125]
    for digits, least in ((0, 0), (1, 0), (2, 1)):
        rows = spark.createDataFrame([(x,) for x in ties if x >= least], "x double").select("x", net.fixed(F.col("x"), digits).alias("t")).collect()
        assert [r["t"] for r in rows] == [f"{r['x']:.{digits}f}" for r in rows]
