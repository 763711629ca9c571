"""Streams that wait: names for flows by nearest time, and captured records for their owner.

Both sides of a join are one stream of tagged rows by key. A key's state holds what
waits and what was said, as JSON; an event-time timer wakes it when the first wait
is over. Rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netquarry.operators.lifecycle import SECOND


def nearest(waiting: list[tuple[int, int]], said: list[tuple[int, str]], tolerance: int, until: int) -> tuple[list[tuple], list, list]:
    """(named, still waiting, still said) once all up to time `until` is known.

    waiting has (time, id), said (time, name). A flow takes the newest name said at most
    `tolerance` before it (of equal times the least), else the first one said after it; it waits until no such name can come.
    """
    named, rest = [], []
    for at, id_ in waiting:
        back = [(-t, n) for t, n in said if at - tolerance <= t <= at]
        if until < (at if back else at + tolerance):
            rest.append((at, id_))
            continue
        ahead = [(t, n) for t, n in said if at < t <= at + tolerance]
        found = min(back) if back else min(ahead) if ahead else None
        named.append((id_, at, found and found[1]))
    first = min([until, *(at for at, _ in rest)]) - tolerance
    return named, rest, [x for x in said if x[0] >= first]


def attributed_nearest(flows: DataFrame, answers: DataFrame, seconds: int = 10) -> DataFrame:
    """(id, at_us, ip, hostname) of every flow (id, ip, ts) with the name of the nearest answer (ip, name, ts): the newest before it, else the first after it, `seconds` away at most.

    The same as joins.attribute() gives in batch. A flow comes out once the watermark has passed
    all answers that could change its name, without a name as well. State of an address: the flows and answers of twice `seconds`.
    """
    tolerance = seconds * SECOND
    one = flows.select("ip", "ts", F.lit(True).alias("asks"), "id", F.lit(None).cast("string").alias("name")).withWatermark("ts", "0 seconds")
    two = answers.select("ip", "ts", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("id"), "name").withWatermark("ts", "0 seconds")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, said = json.loads(state.get[0]) if state.exists else ([], [])
        if not state.hasTimedOut:
            for frame in frames:
                for us, asks, id_, name in zip(*(frame[c].tolist() for c in ("us", "asks", "id", "name"))):
                    (waiting if asks else said).append((us, int(id_)) if asks else (us, name))
        until = state.getCurrentWatermarkMs() * 1000 - 1  # rows at the watermark itself may still come
        named, waiting, said = nearest([tuple(x) for x in waiting], [tuple(x) for x in said], tolerance, until)
        if waiting or said:
            state.update((json.dumps([waiting, said]),))
            # a flow is looked at again when its own time has passed and when its wait is over; names go when no flow can ask for them
            later = [at if until < at else at + tolerance for at, _ in waiting] or [max(t for t, _ in said) + tolerance]
            state.setTimeoutTimestamp(max(min(later) // 1000 + 2, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame([(*key, id_, at, name) for id_, at, name in named], columns=["ip", "id", "at_us", "hostname"])

    rows = one.unionByName(two).withColumn("us", F.unix_micros("ts"))
    found = rows.groupBy("ip").applyInPandasWithState(fold, "ip string, id long, at_us long, hostname string", "data string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("hostname", F.rtrim("hostname", F.lit(".")))


def released(queue: list[dict], owners: dict[str, str], until: int, wait: int, most_rows: int, most_bytes: int) -> tuple[list[dict], list[dict]]:
    """(written, still queued): records leave in order of arrival; the first waits until its flow has an owner or `wait` is over, and all behind it with it. Beyond the limits the first leave at once."""
    written, size = [], sum(r["size"] for r in queue)
    while queue:
        head = queue[0]
        owner = owners.get(head["flow"]) if head["flow"] is not None else None
        free = head["flow"] is None or owner is not None or head["us"] + wait <= until
        if not free and len(queue) <= most_rows and size <= most_bytes:
            break
        written.append({**queue.pop(0), "owner": owner})
        size -= head["size"]
    return written, queue


def annotated_records(records: DataFrame, owners: DataFrame, wait_s: float = 2.0, most_rows: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(capture, place, frame_no, owner): a capture's records (capture, frame_no, ts, flow, size) in the order in which an annotated file has them.

    owners (capture, ts, flow, name) says whose flow it is; the first owner of a flow stands. A record without a flow does
    not wait itself. Order is kept by capture, so a capture is one key; its queue is bounded by the two limits, its owners by its flows.
    """
    wait = int(wait_s * SECOND)
    one = records.select("capture", "ts", F.lit(True).alias("record"), "frame_no", "flow", F.col("size").cast("long").alias("size"), F.lit(None).cast("string").alias("name")).withWatermark("ts", "0 seconds")
    two = owners.select("capture", "ts", F.lit(False).alias("record"), F.lit(None).cast("long").alias("frame_no"), "flow", F.lit(0).cast("long").alias("size"), "name").withWatermark("ts", "0 seconds")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, known, place = json.loads(state.get[0]) if state.exists else ([], {}, 0)
        written: list[dict] = []
        if state.hasTimedOut:
            written, queue = released(queue, known, state.getCurrentWatermarkMs() * 1000, wait, most_rows, most_bytes)
        else:
            rows = pd.concat(list(frames)).sort_values(["us", "record", "frame_no"])
            for us, record, frame, flow, size, name in zip(*(rows[c].tolist() for c in ("us", "record", "frame_no", "flow", "size", "name"))):
                if record:
                    queue.append({"us": us, "frame_no": int(frame), "flow": flow, "size": size})
                elif flow is not None:
                    known.setdefault(flow, name)
                out, queue = released(queue, known, us, wait, most_rows, most_bytes)
                written += out
        state.update((json.dumps([queue, known, place + len(written)]),))
        if queue:
            state.setTimeoutTimestamp(max((queue[0]["us"] + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, place + k, r["frame_no"], r["owner"]) for k, r in enumerate(written)], columns=["capture", "place", "frame_no", "owner"])

    rows = one.unionByName(two).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("capture").applyInPandasWithState(fold, "capture string, place long, frame_no long, owner string", "data string", "append", GroupStateTimeout.EventTimeTimeout)
