"""The nearest span about a packet's time, against all pairs."""

import random
import re

from netquarry.operators import joins


def test_equal_spans_meet_as_one(spark):
    draw = random.Random(7)
    places = [(k, first, first + draw.choice([0, 3, 40, 5000])) for k in range(3) for first in (-900, 0, 17, 64, 70_000)]
    spans = [(*draw.choice(places), line) for line in range(400)] + [(1, 500, 100, 1000), (None, 0, 9, 1001)]
    packets = [(n, draw.choice([0, 1, 2, 3, None]), draw.choice([-910, -890, 0, 5, 20, 30, 66, 900, 5010, 70_001, 10**9, None])) for n in range(300)]
    rows = spark.createDataFrame(packets, "frame_no long, k int, us long")
    table = spark.createDataFrame(spans, "k int, first_us long, last_us long, line long")
    found = joins.interval_match(rows, table, ["k"], 10)
    wanted = {}
    for n, k, us in packets:
        near = [(max(first - us, us - last, 0), line) for other, first, last, line in spans if None not in (k, us) and other == k and first - 10 <= us <= last + 10]
        if near:
            wanted[n] = min(near)
    assert {r["frame_no"]: (r["distance_us"], r["line"]) for r in found.collect()} == wanted
    assert len(wanted) > 100
    # before they are shuffled to their buckets, equal spans are one row
    assert "Aggregate [k, first_us, last_us]" in re.sub(r"#\d+L?", "", found._jdf.queryExecution().analyzed().toString())


def test_no_span(spark):
    rows = spark.createDataFrame([(1, 1, 1)], "frame_no long, k int, us long")
    assert joins.interval_match(rows, spark.createDataFrame([], "k int, first_us long, last_us long, line long"), ["k"], 10).count() == 0
