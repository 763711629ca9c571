"""Streams give what the same packets give in batch."""

import os
import pathlib

from pyspark.sql import functions as F

from netquarry.operators import aggregates, lifecycle
from netquarry.plans.packets import packets
from netquarry.streaming import flows

FOLDER = "/root/testdata/sf0.001"


def test_windowed_stream_equals_batch(spark, tmp_path):
    batch = packets(spark, FOLDER, 1_000_000)
    batch.repartition(1).sortWithinPartitions("us").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    query = flows.windowed_traffic(source).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in flows.windowed_traffic(batch).collect()}
    assert {tuple(r) for r in spark.table("windowed").collect()} == want


def test_generations_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    batch = packets(spark, FOLDER, 1_000_000)
    app = aggregates.application_of(F.col("remote_port"))
    last = batch.agg(F.max("us")).first()[0]
    for k in range(3):  # three files in order of time, one a trigger
        batch.where((F.col("us") * 3 / (last + 1)).cast("int") == k).coalesce(1).sortWithinPartitions("us").write.parquet(f"{tmp_path}/in/{k}")
    for k in range(3):
        os.utime(next(pathlib.Path(f"{tmp_path}/in/{k}").glob("*.parquet")), (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = flows.closed_generations(source, application=app).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {tuple(r) for r in spark.table("closed").collect()}
    rows = lifecycle.generations(batch, app).collect()
    assert len(got) == spark.table("closed").count() > 0
    assert {tuple(r) for r in rows if r["closed_us"] is not None} <= got
    # what only the stream has closed were the batch's live rows, idle until the watermark passed them
    live = {(*tuple(r)[:5], r["created_us"]) for r in rows if r["closed_us"] is None}
    extra = got - {tuple(r) for r in rows}
    assert {(*r[:5], r[6]) for r in extra} <= live and all(r[10] == "timeout" for r in extra)
