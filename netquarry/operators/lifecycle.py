"""Connection lifecycles: packets folded in time order into generations of flows.

In batch, packets are shuffled once by flow and sorted within partitions (the sort
spills), and each task folds its rows as they stream by, holding one flow at a
time; so memory does not grow with a flow's length. The stream processor in
netquarry.streaming uses the same rules with the flow held as state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import coded
from netquarry.plans.packets import FLOW

SECOND = 1_000_000
HALF, FULL = 1 << 31, 1 << 32

# Fixed values: (state, syn, ack, fin, outgoing) -> next state; None matches either.
TRANSITIONS = [
    ("TCP_UNKNOWN", 1, 0, 0, 0, "SYN_RECV"),
    ("TCP_UNKNOWN", 1, 0, 0, 1, "SYN_SENT"),
    ("SYN_SENT", 1, 1, 0, 0, "ESTABLISHED"),
    ("SYN_RECV", 0, 1, 0, 1, "ESTABLISHED"),
    ("TCP_UNKNOWN", 0, 1, None, None, "ESTABLISHED"),
    ("ESTABLISHED", 0, None, 1, 1, "FIN_WAIT1"),
    ("ESTABLISHED", 0, None, 1, 0, "CLOSE_WAIT"),
    ("FIN_WAIT1", 0, 1, 0, 0, "FIN_WAIT2"),
    ("FIN_WAIT1", 0, None, 1, 0, "CLOSING"),
    ("FIN_WAIT2", 0, None, 1, 0, "TIME_WAIT"),
    ("CLOSE_WAIT", 0, None, 1, 1, "LAST_ACK"),
    ("LAST_ACK", 0, 1, 0, 0, "CLOSED"),
    ("CLOSING", 0, 1, 0, 0, "TIME_WAIT"),
]
# Idle seconds after which a flow is closed.
TCP_TIMEOUTS = {"ESTABLISHED": 300, "TIME_WAIT": 30, "CLOSING": 30, "CLOSED": 15, "FIN_WAIT1": 60, "FIN_WAIT2": 60, "CLOSE_WAIT": 60, "LAST_ACK": 60, "SYN_SENT": 60, "SYN_RECV": 60, "TCP_UNKNOWN": 120}
ESTABLISHED_TIMEOUTS = {"SSH": 1800, "HTTP": 600, "HTTPS": 600}
UDP_TIMEOUTS = {"DNS": 30, "NTP": 30, "MDNS": 30, "LLMNR": 30, "SSDP": 30, "STUN": 30, "DHCP": 60, "SNMP": 60, "NETBIOS": 60, "BITTORRENT": 60, "FTP": 60, "MQTT": 120, "HTTP": 600, "HTTPS": 600, "SSH": 1800}
QUIC_TIMEOUTS = {"QUIC_INITIAL": 60, "QUIC_HANDSHAKE": 60, "QUIC_CONNECTED": 180, "QUIC_DRAINING": 15, "QUIC_CLOSED": 15}
QUIC_ORDER = {s: k for k, s in enumerate(QUIC_TIMEOUTS)}
OTHER_TIMEOUTS = {"ICMP": 10, "IGMP": 10, "ARP": 30}
TERMINAL = ("TIME_WAIT", "CLOSED")
CLOSING = (*TERMINAL, "FIN_WAIT1", "FIN_WAIT2", "CLOSE_WAIT", "LAST_ACK", "CLOSING")
TOMBSTONE_S, PROBE_S = 30, 10


def timeout_s(protocol: Column, state: Column, application: Column) -> Column:
    """The idle timeout as a column."""
    established = coded(application, ESTABLISHED_TIMEOUTS, F.lit(300))
    tcp = F.when(state == "ESTABLISHED", established).otherwise(coded(state, TCP_TIMEOUTS, F.lit(120)))
    return F.when(protocol == "TCP", tcp).when(protocol == "UDP", coded(application, UDP_TIMEOUTS, F.lit(60))).otherwise(coded(protocol, OTHER_TIMEOUTS))


def next_state(state: str, syn: bool, ack: bool, fin: bool, rst: bool, out: bool) -> str:
    if rst:
        return "CLOSED"
    seen = (syn, ack, fin, out)
    return next((to for s, *want, to in TRANSITIONS if s == state and all(w is None or w == x for w, x in zip(want, seen))), state)


def before(a: int, b: int) -> bool:
    """a before b among 32-bit sequence numbers."""
    return (a - b) % FULL >= HALF


@dataclass
class Generation:
    state: str
    created_us: int
    last_us: int
    terminal_us: int | None = None
    closed_us: int | None = None
    close_reason: str | None = None
    direction: bool | None = None
    bytes_sent: int = 0
    bytes_received: int = 0
    packets_sent: int = 0
    packets_received: int = 0
    retransmits: int = 0
    out_of_order: int = 0
    duplicate_acks: int = 0
    fast_retransmits: int = 0
    srtt_us: int | None = None
    high_out: int | None = None
    high_in: int | None = None
    last_ack: int | None = None
    ack_run: int = 0
    probe_seq: int | None = None
    probe_us: int | None = None
    application: str | None = None


class Flow:
    """One flow's live generation and what is remembered of the closed one."""

    def __init__(self, live: Generation | None = None, tombstone_us: int | None = None):
        self.live, self.tombstone_us = live, tombstone_us

    def deadline(self, protocol: str) -> int:
        g = self.live
        if protocol == "TCP":
            limit = ESTABLISHED_TIMEOUTS.get(g.application, 300) if g.state == "ESTABLISHED" else TCP_TIMEOUTS[g.state]
        else:
            limit = (UDP_TIMEOUTS | QUIC_TIMEOUTS).get((g.application or "").upper(), 60) if protocol == "UDP" else OTHER_TIMEOUTS.get(protocol, 60)
        return (g.terminal_us if g.terminal_us is not None else g.last_us) + limit * SECOND

    def close(self, at: int, reason: str) -> Generation:
        done, self.live = self.live, None
        done.closed_us, done.close_reason = at, reason
        self.tombstone_us = at if done.state in TERMINAL else None
        return done

    def packet(self, p: tuple, protocol: str, application: str | None) -> list[Generation]:
        """Fold in (us, out, len, syn, ack, fin, rst, seq, ackno, payload); the generations that it closed.

        application is what this packet shows, or None; a generation keeps the first, which sets its timeouts from then on. QUIC
        is given by its states, which only go forward.
        """
        us, out, length, syn, ack, fin, rst, seq, ackno, payload = p
        closed: list[Generation] = []
        if self.live and us > (limit := self.deadline(protocol)):
            closed.append(self.close(limit, "timeout"))
        elif self.live and protocol == "TCP" and syn and self.live.state in CLOSING:
            closed.append(self.close(us, "new_generation"))
        if not self.live:
            late = protocol == "TCP" and not syn and (fin or rst or (ack and not payload))
            if late and self.tombstone_us is not None and 0 <= us - self.tombstone_us <= TOMBSTONE_S * SECOND:
                return closed
            state = next_state("TCP_UNKNOWN", syn, ack, fin, rst, out) if protocol == "TCP" else protocol
            direction = {"SYN_SENT": True, "SYN_RECV": False}.get(state, (not out) if protocol == "TCP" and syn and ack else None)
            self.live = Generation(state, us, us, direction=direction)
        else:
            g = self.live
            g.last_us = max(g.last_us, us)
            if protocol == "TCP":
                g.state = next_state(g.state, syn, ack, fin, rst, out)
                self._segment(g, us, out, ack, seq, ackno, payload + syn + fin)
        g = self.live
        if g.application is None or (g.application in QUIC_TIMEOUTS and QUIC_ORDER.get(application, -1) > QUIC_ORDER[g.application]):
            g.application = application
        g.terminal_us = (us if g.terminal_us is None else g.terminal_us) if g.state in TERMINAL else None
        if out:
            g.bytes_sent, g.packets_sent = g.bytes_sent + length, g.packets_sent + 1
        else:
            g.bytes_received, g.packets_received = g.bytes_received + length, g.packets_received + 1
        return closed

    @staticmethod
    def _segment(g: Generation, us: int, out: bool, ack: bool, seq: int, ackno: int, used: int) -> None:
        end = (seq + used) % FULL
        if out and used:
            if g.high_out is not None and not before(g.high_out, end):
                g.retransmits += 1
                g.probe_seq = None
                return
            g.high_out = end
            if g.probe_seq is None or us - g.probe_us > PROBE_S * SECOND:
                g.probe_seq, g.probe_us = end, us
        elif not out:
            if used:
                if g.high_in is not None and not before(g.high_in, end):
                    g.out_of_order += 1
                else:
                    g.high_in = end
            if ack and g.probe_seq is not None and not before(ackno, g.probe_seq):
                rtt = us - g.probe_us
                g.srtt_us = rtt if g.srtt_us is None else (g.srtt_us * 7 + rtt) // 8
                g.probe_seq = None
            if ack and not used:
                if g.last_ack is None:
                    g.last_ack = ackno
                elif ackno == g.last_ack:
                    g.ack_run += 1
                    g.duplicate_acks += 1
                    g.fast_retransmits += g.ack_run == 3
                elif before(g.last_ack, ackno):
                    g.last_ack, g.ack_run = ackno, 0


SHOWN = ["state", "created_us", "last_us", "terminal_us", "closed_us", "close_reason", "direction", "bytes_sent", "bytes_received", "packets_sent", "packets_received", "retransmits", "out_of_order", "duplicate_acks", "fast_retransmits", "srtt_us"]
_KEY_DDL = "protocol string, local_ip string, local_port int, remote_ip string, remote_port int"
DDL = f"{_KEY_DDL}, state string, created_us long, last_us long, terminal_us long, closed_us long, close_reason string, direction boolean, bytes_sent long, bytes_received long, packets_sent long, packets_received long, retransmits long, out_of_order long, duplicate_acks long, fast_retransmits long, srtt_us long"
PACKET = ["us", "is_outgoing", "packet_len", "syn", "ack_flag", "fin", "rst", "seq", "ack", "payload_len"]


def generations(packets: DataFrame, application: Column | None = None) -> DataFrame:
    """One row a generation of a flow, named by its created_us; the one still live at the end has no closed_us.

    Packets of equal time go by frame number. `application` is what a packet shows, or NULL; the first of a generation sets its timeouts.
    """
    whole = [F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in ("seq", "ack", "payload_len") else F.coalesce(c, F.lit(False)).alias(c) if c in ("syn", "ack_flag", "fin", "rst") else F.col(c) for c in PACKET]
    rows = packets.select(*FLOW, F.lit(None).cast("string").alias("application") if application is None else application.alias("application"), "frame_no", *whole)
    dealt = rows.repartition(*FLOW).sortWithinPartitions(*FLOW, "us", "frame_no")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, flow = None, Flow()
        made: list[tuple] = []

        def row(g: Generation) -> None:
            made.append((*key, *(getattr(g, c) for c in SHOWN)))

        def batch() -> pd.DataFrame:
            names = [c.split()[0] for c in DDL.split(", ")]
            return pd.DataFrame(made, columns=names).astype({c: "Int64" for c in ("terminal_us", "closed_us", "srtt_us")} | {"direction": "boolean"})

        for frame in frames:
            columns = [frame[c].tolist() for c in [*FLOW, "application", *PACKET]]
            for *k, app, us, out, length, syn, ack, fin, rst, seq, ackno, payload in zip(*columns):
                if tuple(k) != key:
                    if key and flow.live:
                        row(flow.live)
                    key, flow = tuple(k), Flow()
                for g in flow.packet((us, out, length, syn, ack, fin, rst, seq, ackno, payload), key[0], app):
                    row(g)
            if len(made) > 10_000:
                yield batch()
                made.clear()
        if key and flow.live:
            row(flow.live)
        yield batch()

    return dealt.mapInPandas(fold, DDL)


def assigned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (FLOW, us, frame_no, ...) with the created_us of the generation that they fall into; those of none are left out.

    One window by flow, in order of time: a generation begins before the packets of its time, and each row takes the
    last one begun, if the row is not after its last packet. So the work grows with the rows, not with rows x generations.
    """
    given = [c for c in rows.columns if c not in FLOW]
    begins = found.select(*FLOW, F.col("created_us").alias("__at"), F.struct("created_us", "last_us").alias("__g"))
    asked = rows.select(*FLOW, F.col("us").alias("__at"), F.struct(*given).alias("__row"))
    both = asked.unionByName(begins, allowMissingColumns=True)
    passed = Window.partitionBy(*FLOW).orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__g", F.last("__g", ignorenulls=True).over(passed)).where("__row is not null and __at <= __g.last_us")
    return held.select(*FLOW, F.col("__g.created_us").alias("created_us"), "__row.*")


def retained(closed: DataFrame, live: DataFrame, most: int = 5000) -> DataFrame:
    """Live rows and the newest `most` closed ones."""
    kept = closed.orderBy(F.desc("closed_us"), *FLOW, "created_us").limit(most)
    return live.unionByName(kept)
