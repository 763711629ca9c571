"""Waiting streams: nearest names equal the batch join; records leave in order, attributed or after their wait."""

import os
import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import joins
from netquarry.streaming import waiting

SECOND = 1_000_000
EPOCH = 1_700_000_000 * SECOND


@pytest.fixture
def replay(spark, tmp_path):
    """Feeds lists of rows as one file a trigger and returns what the stream gave."""

    def run(name, schemas, parts, build):
        sources = []
        for side, schema in enumerate(schemas):
            for k, rows in enumerate(parts):
                frame = spark.createDataFrame(rows[side], schema).withColumn("ts", F.timestamp_micros("at"))
                frame.coalesce(1).write.parquet(f"{tmp_path}/{side}/{k}")
                for f in os.listdir(f"{tmp_path}/{side}/{k}"):
                    if f.endswith(".parquet"):
                        os.utime(f"{tmp_path}/{side}/{k}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
            sources.append(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{side}"))
        query = build(*sources).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return [tuple(r) for r in spark.table(name).collect()]

    return run


def test_nearest_names_equal_the_batch_join(spark, replay):
    rng = random.Random(4)
    flows = sorted((EPOCH + rng.randrange(200 * SECOND), k, f"ip{rng.randrange(6)}") for k in range(150))
    answers = sorted((EPOCH + rng.randrange(200 * SECOND), f"ip{rng.randrange(6)}", rng.choice(["a.", "b", "c.d."])) for _ in range(60))
    end = EPOCH + 1000 * SECOND
    parts = []
    for k in range(4):
        inside = lambda at: EPOCH + 50 * SECOND * k <= at < EPOCH + 50 * SECOND * (k + 1)  # noqa: B023, E731
        parts.append(([(at, i, ip) for at, i, ip in flows if inside(at)], [x for x in answers if inside(x[0])]))
    parts += [([(end + j * SECOND, -1 - j, "none")], [(end + j * SECOND, "none", "x")]) for j in range(3)]  # time goes on
    got = replay("nearest", ("at long, id long, ip string", "at long, ip string, name string"), parts, waiting.attributed_nearest)
    batch = joins.attribute(spark.createDataFrame(flows, "at long, id long, ip string"), spark.createDataFrame(answers, "at long, ip string, name string"), "ip")
    want = {r["id"]: r["hostname"] for r in batch.collect()}
    found = {id_: name for _, id_, _, name in got if id_ >= 0}
    assert found == want and len(got) - len(found) <= 3
    assert {None} < set(want.values())


def record(at, frame, flow, size=10):
    return (EPOCH + int(at * SECOND), "eth0", frame, flow, size)


def owner(at, flow, name):
    return (EPOCH + int(at * SECOND), "eth0", flow, name)


RECORDS, OWNERS = "at long, capture string, frame_no long, flow string, size long", "at long, capture string, flow string, name string"
LATER = [([record(100 + k, 900 + k, None)], [owner(100 + k, None, None)]) for k in range(3)]


def test_the_head_waits_and_the_rest_stay_behind_it(replay):
    parts = [
        ([record(0, 1, "a"), record(0.1, 2, "b"), record(0.2, 3, None)], [owner(0.05, "b", "ssh")]),
        ([record(1.2, 4, "a")], [owner(1, "a", "curl"), owner(1.1, "a", "other")]),  # in time: 1, 2, 3 go in order
        ([record(3, 5, "c"), record(3.5, 6, "b")], [owner(2.9, "x", "y")]),
        ([record(5.2, 7, "b")], [owner(5.3, "c", "late")]),  # 5 waited for two seconds in vain
        *LATER,
    ]
    got = replay("waits", (RECORDS, OWNERS), parts, waiting.annotated_records)
    assert [(p, f, o) for _, p, f, o in sorted(got) if f < 900] == [(0, 1, "curl"), (1, 2, "ssh"), (2, 3, None), (3, 4, "curl"), (4, 5, None), (5, 6, "ssh"), (6, 7, "ssh")]


def test_limits_push_the_first_out():
    queue = [{"us": k, "frame_no": k, "flow": "a", "size": 10} for k in range(6)]
    assert [r["frame_no"] for r in waiting.released(list(queue), {}, 0, 2 * SECOND, 4, 1000)[0]] == [0, 1]
    assert [r["frame_no"] for r in waiting.released(list(queue), {}, 0, 2 * SECOND, 100, 25)[0]] == [0, 1, 2, 3]
    written, left = waiting.released(list(queue), {}, 2 * SECOND + 2, 2 * SECOND, 100, 1000)
    assert [r["frame_no"] for r in written] == [0, 1, 2] and len(left) == 3 and all(r["owner"] is None for r in written)
