"""The lifecycle fold and windowed traffic as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netquarry.operators.lifecycle import DDL, PACKET, SECOND, SHOWN, TOMBSTONE_S, Flow, Generation
from netquarry.plans.packets import FLOW


def closed_generations(packets: DataFrame, delay: str = "10 seconds", application: Column | None = None) -> DataFrame:
    """Generations as they close, from a stream of packets with an event time `ts`.

    State is one flow's live generation, tombstone and application, which sets its
    timeouts as in batch. An event-time timer at the generation's deadline closes
    idle flows once the watermark passes it; then the tombstone stays until it expires
    itself, so a late FIN or RST starts no new flow. A generation is named by its
    flow and created_us.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flow, app, offset = Flow(), None, 0
        if state.exists:
            live, tombstone, app, offset = json.loads(state.get[0])
            flow = Flow(Generation(**live) if live else None, tombstone)
        made: list[Generation] = []
        if state.hasTimedOut:
            if flow.live:
                made.append(flow.close(flow.deadline(key[0]), "timeout"))
            else:
                flow.tombstone_us = None
        else:
            rows = pd.concat(list(frames)).sort_values(["us", "frame_no"])
            offset = int(rows["offset"].iloc[0])  # `us` may count from any epoch, timers count from 1970
            for app, *packet in zip(rows["application"].tolist(), *(rows[c].tolist() for c in PACKET)):
                made += flow.packet(tuple(packet), key[0], app)
        due = flow.deadline(key[0]) if flow.live else flow.tombstone_us + TOMBSTONE_S * SECOND if flow.tombstone_us is not None else None
        if due is None:
            state.remove()
        else:
            state.update((json.dumps([asdict(flow.live) if flow.live else None, flow.tombstone_us, app, offset]),))
            state.setTimeoutTimestamp(max((due + offset) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = [(*key, *(getattr(g, c) for c in SHOWN)) for g in made]
        names = [c.split()[0] for c in DDL.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("terminal_us", "closed_us", "srtt_us")} | {"direction": "boolean"})

    app = (F.lit(None).cast("string") if application is None else application).alias("application")
    rows = packets.withWatermark("ts", delay).select("ts", *FLOW, app, (F.unix_micros("ts") - F.col("us")).alias("offset"), "frame_no", *PACKET)
    return rows.groupBy(*FLOW).applyInPandasWithState(fold, DDL, "data string", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_traffic(packets: DataFrame, width: str = "10 seconds", slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """Bytes and packets by protocol and event-time window; tumbling without a slide."""
    out = F.col("is_outgoing")
    by = F.window("ts", width, slide) if slide else F.window("ts", width)
    return packets.withWatermark("ts", delay).groupBy(by.alias("w"), "protocol").agg(F.sum(F.when(out, F.col("packet_len")).otherwise(0)).alias("tx"), F.sum(F.when(out, 0).otherwise(F.col("packet_len"))).alias("rx"), F.count(F.lit(1)).alias("packets")).select(F.unix_micros("w.start").alias("start_us"), "protocol", "tx", "rx", "packets")


def deduplicated(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Packets once by frame number, within the watermark."""
    return packets.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["frame_no"])


def attributed(flows: DataFrame, answers: DataFrame, seconds: int = 10) -> DataFrame:
    """Stream-stream left join of flows with name answers of their remote address within so many seconds either way."""
    f = flows.withWatermark("ts", f"{seconds} seconds").alias("f")
    a = answers.withWatermark("answered_at", f"{seconds} seconds").alias("a")
    near = F.expr(f"f.remote_ip = a.ip and a.answered_at between f.ts - interval {seconds} seconds and f.ts + interval {seconds} seconds")
    return f.join(a, near, "leftOuter")
