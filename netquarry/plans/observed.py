"""From captured frames to enriched connections in one plan: decode, dissect, fold, time, attribute, look up.

Frames are decoded and dissected once: the dissected packets are written as Parquet to the session's shared checkpoint
folder, and the steps below read the columns that they need. Every step groups by flow and generation and is put together by equi-joins of one row a generation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.net import coded
from netquarry.operators import decode, dpi, joins, latency, lifecycle
from netquarry.plans.packets import FLOW

KEY = [*FLOW, "created_us"]
TOLERANCE_US = 10 * latency.SECOND
#: Applications whose flows get no name from answers, and kinds of round trips of the transport; the others time a service.
UNNAMED = ("DNS", "mDNS", "LLMNR", "DHCP", "SSDP", "NetBIOS")
TRANSPORT = ("handshake", "quic", "icmp")


def written(rows: DataFrame) -> DataFrame:
    """rows, read back from the shared checkpoint folder that the session names, or a temporary one of a local session; the folder is the session owner's to clear."""
    folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder and not rows.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("a cluster session needs spark.checkpoint.dir")
    folder = folder or tempfile.mkdtemp(prefix="spark-")
    path = f"{folder.rstrip('/')}/observed-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def answered(seen: DataFrame) -> DataFrame:
    """Names by address from DNS answers: ip, at, name; loopback and unspecified addresses name nothing."""
    said = F.col("dpi")
    rows = seen.where((said["app"] == "DNS") & said["is_response"] & said["query"].isNotNull())
    each = rows.select(F.explode("dpi.ips").alias("ip"), F.col("us").alias("at"), F.rtrim("dpi.query", F.lit(".")).alias("name"))
    return each.where(~F.col("ip").rlike(r"^(?:127\.|0\.0\.0\.0$|::1?$)")).where("name <> ''")


def named(flows: DataFrame, answers: DataFrame) -> DataFrame:
    """flows (KEY, dpi, named_us) with the hostname of their remote address: the freshest answer before their start, else the first after it.

    A flow that showed its own name by then (named_us) keeps that, and UNNAMED applications and ARP get none.
    """
    asked = flows.where((F.col("protocol") != "ARP") & ~F.coalesce(F.col("dpi.app").isin(*UNNAMED), F.lit(False)))
    left = asked.select(F.col("remote_ip").alias("ip"), F.col("created_us").alias("at"), F.struct(*KEY).alias("id"))
    found = [joins.as_of(left, answers, "ip", TOLERANCE_US, forward=f).select("id.*", F.col("name").alias(n), F.col("observed_at").alias(f"{n}_at")) for n, f in (("__back", False), ("__ahead", True))]
    told = flows.join(found[0], KEY, "left").join(found[1], KEY, "left")
    free = lambda at: F.col("named_us").isNull() | (at < F.col("named_us"))
    return told.withColumn("hostname", F.coalesce(F.when(free(F.col("created_us")), F.col("__back")), F.when(free(F.col("__ahead_at")), F.col("__ahead")))).drop("__back", "__back_at", "__ahead", "__ahead_at")


def timed(seen: DataFrame, found: DataFrame) -> DataFrame:
    """KEY, rtt_us (the first round trip of the transport) and response_us (the last answer of a service)."""
    placed = lifecycle.assigned(latency.measured(seen), found)
    order, transport = F.struct("us", "frame_no"), F.col("kind").isin(*TRANSPORT)
    return placed.groupBy(*KEY).agg(F.min_by("latency_us", F.when(transport, order)).alias("rtt_us"), F.max_by("latency_us", F.when(~transport, order)).alias("response_us"))


def connections(frames: DataFrame, local: DataFrame, services: DataFrame, sockets: DataFrame, kernel: DataFrame | None = None) -> DataFrame:
    """One row a generation of a flow: its fold, what inspection found, its state as shown, latencies, the name of its peer, service and owner.

    frames (frame_no, us, linktype, data), local (ip), services (protocol, port, name), sockets and kernel (FLOW, pid, name).
    """
    seen = written(dpi.dissect(decode.packets(frames, local)))
    app = F.col("dpi.app")
    found = written(lifecycle.generations(seen, F.when(app == "QUIC", coded(F.col("dpi.kind"), dpi.QUIC_STATES)).otherwise(app)))
    placed = lifecycle.assigned(seen.select(*FLOW, "us", "frame_no", "is_outgoing", "packet_len", "dpi", "icmp_type", "icmp_id", "op", "target_ip", "sender_mac"), found)
    told = dpi.connections(placed.where("dpi is not null"), KEY).select(*KEY, "dpi")
    told = dpi.with_hellos(dpi.with_quic(told, seen), seen)
    order = F.struct("us", "frame_no")
    host = F.when(dpi.authoritative(F.col("dpi")).isNotNull(), F.col("us"))
    facts = placed.groupBy(*KEY).agg(F.min(host).alias("named_us"), F.max_by(F.struct("icmp_type", "icmp_id", "op", "target_ip", "sender_mac"), order).alias("__l"))
    rows = found.join(told, KEY, "left").join(facts, KEY, "left").join(timed(seen, found), KEY, "left")
    whole = joins.with_service(named(rows, answered(seen)), services)
    whole = joins.kernel_owner(whole, sockets.where(F.lit(False)) if kernel is None else kernel, sockets, KEY)
    none, last = F.lit(None), F.col("__l")
    shown = dpi.state(F.col("protocol"), F.col("state"), F.col("dpi"), F.lit(0), last["icmp_type"], last["icmp_id"], none, none, last["op"], last["target_ip"], last["sender_mac"], none)
    return whole.withColumns({"application": dpi.display(F.col("dpi")), "shown_state": shown}).drop("__l", "named_us")
