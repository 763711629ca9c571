"""Request and response latency by one window, without a join.

A pending request is overwritten by the next request of its key and taken by a
response, so a response matches exactly when the event before it, among requests
and responses of its key, is a request that is not too old.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import coded
from netquarry.plans.packets import FLOW

SECOND = 1_000_000

#: Seconds a request waits.
MAX_AGE = {"handshake": 30, "quic": 30} | dict.fromkeys(["dns", "llmnr", "netbios", "icmp", "stun", "ntp"], 10)


def matched(events: DataFrame, keys: list[str], request: Column, response: Column, kind: str) -> DataFrame:
    """The matched responses with latency_us."""
    by = Window.partitionBy(*keys).orderBy("us", "frame_no")
    marked = events.withColumn("__request", F.when(request, True).when(response, False)).where("__request is not null")
    before = F.lag(F.struct(F.col("__request").alias("r"), F.col("us").alias("at"))).over(by)
    paired = marked.withColumn("__before", before).where("not __request and __before.r")
    return paired.withColumn("latency_us", F.col("us") - F.col("__before.at")).where(F.col("latency_us").between(0, MAX_AGE[kind] * SECOND - 1)).drop("__request", "__before")


def summary(found: DataFrame, keys: list[str], first: bool = False) -> DataFrame:
    """By key: matches, their sum, and the first or last latency."""
    order = F.struct("us", "frame_no")
    pick = F.min_by("latency_us", order) if first else F.max_by("latency_us", order)
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.sum("latency_us").alias("sum_us"), pick.alias("latency_us"))


def handshake(packets: DataFrame) -> DataFrame:
    """SYN out, SYN or SYN-ACK in; the first match stands."""
    tcp = packets.where("protocol = 'TCP'")
    return summary(matched(tcp, FLOW, F.col("syn") & F.col("is_outgoing"), F.col("syn") & ~F.col("is_outgoing"), "handshake"), FLOW, first=True)


def transactions(packets: DataFrame, where: Column, kind: str, keys: list[str]) -> DataFrame:
    """Requests out and responses in, paired by keys; the last match stands."""
    return summary(matched(packets.where(where), keys, F.col("is_outgoing"), ~F.col("is_outgoing"), kind), keys)


def netbios(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Name queries out and answers in, of dissected packets; a WACK asks to go on waiting, so the query stays pending over it."""
    said, asks = F.col("dpi"), ~F.col("dpi.is_response") & (F.col("dpi.command") != "WACK")
    return summary(matched(packets.where(said["app"] == "NetBIOS"), keys, F.col("is_outgoing") & asks, ~F.col("is_outgoing") & said["is_response"], "netbios"), keys)


#: QUIC packets that belong to a handshake.
QUIC_HANDSHAKE = ("Initial", "Handshake", "Retry", "Version Negotiation")


def measured(seen: DataFrame) -> DataFrame:
    """Every latency that dissected packets show: FLOW, us, frame_no, kind, latency_us; one row for each flow that it stamps.

    Requests and responses of all protocols are paired in one window by kind, local end, remote end and the token that a
    response gives back: a transaction id, an echo's identifier and number, the time an NTP client sent. LLMNR and NetBIOS
    answers come from another address than was asked, so the remote end is no part of their key and the asking flow is
    stamped too. A reply on the loopback address counts as incoming. Packets without dpi give handshakes and echoes only.
    """
    said, out = F.col("dpi"), F.col("is_outgoing")
    app, tcp, icmp = said["app"], F.col("protocol") == "TCP", F.col("protocol") == "ICMP"
    echo, reply = icmp & F.col("icmp_type").isin(8, 128), icmp & F.col("icmp_type").isin(0, 129)
    sent = out & ~(reply & (F.col("local_ip") == F.col("remote_ip")))
    answer, text = said["is_response"], lambda *c: F.concat_ws(" ", *(x.cast("string") for x in c))
    rules = [
        ("handshake", tcp & F.col("syn"), ~F.col("ack_flag"), F.col("ack_flag"), F.lit("")),
        ("icmp", echo | reply, sent & echo, ~sent & reply, text(F.col("icmp_id"), F.col("icmp_seq"))),
        ("quic", (app == "QUIC") & said["kind"].isin(*QUIC_HANDSHAKE), sent, ~sent, F.lit("")),
        ("dns", app == "DNS", sent & ~answer, ~sent & answer, said["txid"]),
        ("llmnr", app == "LLMNR", sent & ~answer, ~sent & answer, said["txid"]),
        ("netbios", app == "NetBIOS", sent & ~answer & (said["command"] != "WACK"), ~sent & answer, text(said["kind"], said["txid"])),
        ("stun", app == "STUN", sent & (said["kind"] == "Request"), ~sent & said["kind"].isin("Success", "Error"), said["txid"]),
        ("ntp", app == "NTP", sent & (said["kind"] == "Client"), ~sent & (said["kind"] == "Server"), F.when(sent, said["transmit"]).otherwise(said["txid"])),
    ]
    facts = None
    for kind, test, asks, answers, token in rules:
        one = F.struct(F.lit(kind).alias("kind"), F.when(asks, True).when(answers, False).alias("asks"), token.alias("token"))
        facts = F.when(test, one) if facts is None else facts.when(test, one)
    end = F.struct("remote_ip", "remote_port")
    events = seen.select(*FLOW, "us", "frame_no", facts.alias("__e")).where("__e.asks is not null")
    by = Window.partitionBy("__e.kind", "protocol", "local_ip", "local_port", F.when(~F.col("__e.kind").isin("llmnr", "netbios"), end), "__e.token").orderBy("us", "frame_no")
    before = events.withColumn("__b", F.lag(F.struct(F.col("__e.asks").alias("asks"), "us", "frame_no", end.alias("end"))).over(by))
    age = F.col("us") - F.col("__b.us")
    limit = coded(F.col("__e.kind"), {k: v * SECOND for k, v in MAX_AGE.items()})
    paired = before.where("not __e.asks and __b.asks").where((age >= 0) & (age < limit))
    own = F.struct(end.alias("end"), "us", "frame_no")
    asking = F.struct(F.col("__b.end").alias("end"), F.col("__b.us").alias("us"), F.col("__b.frame_no").alias("frame_no"))
    stamped = paired.withColumn("__s", F.explode(F.when(F.col("__b.end") == end, F.array(own)).otherwise(F.array(own, asking))))
    return stamped.select("protocol", "local_ip", "local_port", "__s.end.remote_ip", "__s.end.remote_port", "__s.us", "__s.frame_no", F.col("__e.kind").alias("kind"), age.alias("latency_us"))
