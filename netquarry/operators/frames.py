"""Frames to packets: one pass over the binary buffer of each Arrow batch, all rows at once.

Header fields are read at per-row offsets from the batch's single byte buffer with
numpy, so a field costs a few array operations a batch. Spark partitions the
frames; nothing but a batch is held. Malformed frames are left out.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Link types whose frames begin with an IP header, and extension headers by next-header number.
RAW_LINKS = (12, 101, 228, 229)
HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION, DESTINATION = 0, 43, 44, 51, 60
MOST_EXTENSIONS = 10
#: Where a neighbour message's options begin, by ICMPv6 type, and which option names the address.
NDP_OPTIONS = {133: (8, 1), 134: (16, 1), 135: (24, 1), 136: (24, 2), 137: (40, 2)}

_LONG, _INT, _TEXT, _BOOL, _BYTES = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.BinaryType()
FIELDS = [
    ("protocol", _TEXT), ("src_port", _INT), ("dst_port", _INT), ("fin", _BOOL), ("syn", _BOOL), ("rst", _BOOL), ("ack_flag", _BOOL),
    ("seq", _LONG), ("ack", _LONG), ("window", _LONG), ("payload_len", _LONG), ("payload", _BYTES), ("icmp_type", _LONG), ("icmp_id", _LONG),
    ("icmp_seq", _LONG), ("igmp_group", _TEXT), ("op", _TEXT), ("sender_mac", _TEXT), ("target_mac", _TEXT), ("ndp_ip", _TEXT), ("ndp_mac", _TEXT),
    ("packet_len", _LONG), ("src", _TEXT), ("dst", _TEXT),
]
PROTOCOLS = np.array(["TCP", "UDP", "ICMP", "IGMP", "ARP"])


class Frames:
    """The bytes of a batch's frames; offsets are relative to each frame."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.start = at[:-1]
        self.size = np.where(np.asarray(column.is_valid()), np.diff(at), 0)

    def number(self, at: np.ndarray | int, n: int, rows: np.ndarray | None = None) -> np.ndarray:
        """n bytes, high byte first; -1 where they are not all inside the frame."""
        start, size = (self.start, self.size) if rows is None else (self.start[rows], self.size[rows])
        ok = (at >= 0) & (at + n <= size)
        value, last = np.zeros(len(start), np.int64), len(self.raw) - 1
        for k in range(n):
            value = value << 8 | self.raw[np.clip(start + at + k, 0, last)]
        return np.where(ok, value, -1)

    def cut(self, row: int, at: int, n: int) -> bytes:
        begin = int(self.start[row]) + at
        return self.raw[begin : begin + n].tobytes() if at + n <= self.size[row] else b""

    def slices(self, at: np.ndarray, length: np.ndarray) -> pa.Array:
        """A binary array of the bytes from at on, cut at the frame's end."""
        n = np.maximum(0, np.minimum(length, self.size - at))
        ends = np.cumsum(n)
        place = np.repeat(self.start + at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(self.raw[place])]).cast(pa.binary())


def _dotted(numbers: np.ndarray) -> pa.Array:
    parts = [pa.array((numbers >> s) & 255).cast(pa.string()) for s in (24, 16, 8, 0)]
    return pc.binary_join_element_wise(*parts, ".")


def _mac(raw: bytes) -> str | None:
    return raw.hex(":") if len(raw) == 6 else None


def _network(f: Frames, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and EtherType of the network header by link type; one 802.1Q tag is skipped, unknown types are Ethernet."""
    at, kind = np.full(len(link), 14), f.number(12, 2)
    for number, header, place in ((113, 16, 14), (276, 20, 0)):
        here = link == number
        at, kind = np.where(here, header, at), np.where(here, f.number(place, 2), kind)
    tagged = kind == 0x8100
    at = np.where(tagged, at + 4, at)
    kind = np.where(tagged, f.number(at - 2, 2), kind)
    raw = np.isin(link, RAW_LINKS) | (link == 0)
    at = np.where(raw, np.where(link == 0, 4, 0), at)
    nibble = f.number(at, 1) >> 4
    return at, np.where(raw, np.where(nibble == 4, 0x0800, np.where(nibble == 6, 0x86DD, -1)), kind)


def _extensions(f: Frames, at: np.ndarray, v6: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next header, its offset, whether a fragment header was seen) behind an IPv6 header's extensions; -1 for fragments but the first."""
    header, place, fragment = np.where(v6, f.number(at + 6, 1), -1), at + 40, np.zeros(len(at), bool)
    for _ in range(MOST_EXTENSIONS):
        plain, auth, cut = np.isin(header, (HOP_BY_HOP, ROUTING, DESTINATION)), header == AUTHENTICATION, header == FRAGMENT
        if not (plain | auth | cut).any():
            break
        size = np.where(cut, 8, np.where(auth, (f.number(place + 1, 1) + 2) * 4, (f.number(place + 1, 1) + 1) * 8))
        later = cut & (f.number(place + 2, 2) >> 3 != 0)
        fragment |= cut
        following = np.where(later, -1, f.number(place, 1))
        walked = plain | auth | cut
        header, place = np.where(walked, following, header), np.where(walked, place + size, place)
    return header, place, fragment


def _neighbour(raw: bytes, source: str) -> tuple[str | None, str | None]:
    """(ip, mac) that an ICMPv6 neighbour message teaches; no mac if any option is malformed."""
    if len(raw) < 8 or raw[1] or raw[0] not in NDP_OPTIONS:
        return None, None
    at, wanted = NDP_OPTIONS[raw[0]]
    if len(raw) < at or (wanted == 2 and len(raw) < 24):
        return None, None
    mac = None
    while at < len(raw):
        size = raw[at + 1] * 8 if at + 8 <= len(raw) else 0
        if not size or at + size > len(raw):
            return None, None
        if mac is None and raw[at] == wanted and size == 8:
            mac = _mac(raw[at + 2 : at + 8])
        at += size
    return ((socket.inet_ntop(socket.AF_INET6, raw[8:24]) if wanted == 2 else source), mac) if mac else (None, None)


def decode(data: pa.Array, link: np.ndarray, protocols: tuple[str, ...] | None = None, ports: tuple[int, ...] | None = None) -> tuple[np.ndarray, pa.RecordBatch]:
    """(kept rows, their FIELDS) of a batch of frames; only of some protocols or ports, if given, before any text is made."""
    f = Frames(data)
    at, kind = _network(f, link)
    v4, v6 = (kind == 0x0800) & (f.number(at, 1) >> 4 == 4), (kind == 0x86DD) & (f.number(at, 1) >> 4 == 6)
    arp = (kind == 0x0806) & (f.number(at, 2) == 1) & (f.number(at + 2, 2) == 0x0800) & np.isin(f.number(at + 6, 2), (1, 2)) & (f.number(at + 24, 4) >= 0)
    ihl = (f.number(at, 1) & 15) * 4
    first = (f.number(at + 6, 2) & 0x1FFF) == 0
    six, six_at, fragment = _extensions(f, at, v6)
    proto = np.where(v4 & first & (ihl >= 20), f.number(at + 9, 1), np.where(v6, six, -1))
    l4 = np.where(v4, at + ihl, six_at)
    length = f.number(at + 4, 2)
    total = f.number(at + 2, 2)  # 0 where the card cuts segments: then all that was captured counts
    end = np.where(v4, np.where(total < ihl, f.size, at + total), np.where(length == 0, f.size, at + 40 + length))
    tcp_head = (f.number(l4 + 12, 1) >> 4) * 4
    tcp = (proto == 6) & (tcp_head >= 20) & (f.number(l4 + 16, 4) >= 0)
    udp = (proto == 17) & (f.number(l4 + 4, 2) >= 8)
    icmp = np.isin(proto, (1, 58)) & (f.number(l4, 1) >= 0)
    igmp = (proto == 2) & (f.number(l4, 1) >= 0)
    code = np.select([tcp, udp, icmp, igmp, arp], range(5), -1)
    keep = code >= 0
    ported = tcp | udp
    src_port, dst_port = (np.where(ported, f.number(l4 + k, 2), 0) for k in (0, 2))
    if protocols is not None:
        keep &= np.isin(PROTOCOLS[code], protocols)
    if ports is not None:
        keep &= np.isin(src_port, ports) | np.isin(dst_port, ports)
    rows = np.flatnonzero(keep)
    pick = lambda x: x[rows]
    long = lambda x, where: pa.array(pick(x), pa.int64(), mask=~pick(where))
    flags = f.number(l4 + 13, 1)
    bit = lambda b: pa.array(pick(flags & b != 0), mask=~pick(tcp))
    echo = icmp & np.isin(f.number(l4, 1), (0, 8, 128, 129))
    head = np.where(tcp, tcp_head, np.where(udp, 8, 0))
    used = np.maximum(end - l4 - head, 0)

    own = Frames(data.take(pa.array(rows)))
    four = pick(v4 | arp)
    text = []
    for a4, a6, hw in ((12, 8, 14), (16, 24, 24)):
        place = np.where(pick(arp), pick(at) + hw, pick(at) + a4)
        out = pc.if_else(pa.array(four), _dotted(own.number(place, 4)), pa.scalar(None, pa.string()))
        if not four.all():  # IPv6 texts, each address of the batch once
            known: dict[bytes, str] = {}
            found = [None if yes else known.setdefault(raw := own.cut(k, int(a) + a6, 16), socket.inet_ntop(socket.AF_INET6, raw) if raw not in known and raw else known.get(raw, "")) for k, (yes, a) in enumerate(zip(four, pick(at)))]
            out = pc.coalesce(out, pa.array(found, pa.string()))
        text.append(out)
    sender, target = [None] * len(rows), [None] * len(rows)
    for k in np.flatnonzero(pick(arp)):
        sender[k], target[k] = (_mac(own.cut(k, int(at[rows[k]]) + off, 6)) for off in (8, 18))
    ndp_ip, ndp_mac = [None] * len(rows), [None] * len(rows)
    teach = v6 & icmp & ~fragment & (f.number(at + 7, 1) == 255) & np.isin(f.number(l4, 1), tuple(NDP_OPTIONS))
    for k in np.flatnonzero(pick(teach)):
        r = rows[k]
        ndp_ip[k], ndp_mac[k] = _neighbour(own.cut(k, int(l4[r]), int(min(end[r], f.size[r]) - l4[r])), text[0][k].as_py())
    op = np.where(arp, np.where(f.number(at + 6, 2) == 1, "request", "reply"), "")
    group = igmp & (f.number(l4, 1) != 0x22) & (f.number(l4 + 4, 4) >= 0)
    columns = [
        pa.array(PROTOCOLS[code[rows]]), pa.array(pick(src_port), pa.int32()), pa.array(pick(dst_port), pa.int32()), bit(1), bit(2), bit(4), bit(16),
        long(f.number(l4 + 4, 4), tcp), long(f.number(l4 + 8, 4), tcp), long(f.number(l4 + 14, 2), tcp), long(used, tcp | udp), own.slices(pick(l4 + head), pick(np.where(ported, used, 0))),
        long(f.number(l4, 1), icmp), long(f.number(l4 + 4, 2), echo), long(f.number(l4 + 6, 2), echo),
        pc.if_else(pa.array(pick(group)), _dotted(own.number(pick(l4) + 4, 4)), pa.scalar(None, pa.string())),
        pa.array(op[rows], mask=~pick(arp)), pa.array(sender, pa.string()), pa.array(target, pa.string()), pa.array(ndp_ip, pa.string()), pa.array(ndp_mac, pa.string()),
        pa.array(pick(np.where(arp, f.size, end))), *text,
    ]
    return rows, pa.RecordBatch.from_arrays(columns, [n for n, _ in FIELDS])


def packets(frames: DataFrame, local: DataFrame, protocols: tuple[str, ...] | None = None, ports: tuple[int, ...] | None = None) -> DataFrame:
    """Decoded packets: TCP, UDP, ICMP, IGMP and ARP over IPv4, and TCP, UDP and ICMPv6 over IPv6.

    `local` (ip) lists the host's own addresses; a packet from one of them is
    outgoing. Fragments but the first, and frames that do not decode, are left out.
    `protocols` and `ports` are a capture filter that the decoder applies itself.
    ndp_ip and ndp_mac are what an IPv6 neighbour message teaches.
    """
    kept = [c for c in frames.columns if c not in ("data", *(n for n, _ in FIELDS))]
    schema = T.StructType([frames.schema[c] for c in kept] + [T.StructField(n, t) for n, t in FIELDS])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link = np.asarray(batch.column(batch.num_columns - 1).fill_null(1), np.int64)
            rows, found = decode(batch.column(batch.num_columns - 2), link, protocols, ports)
            given = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*given.columns[: len(kept)], *found.columns], names)

    rows = frames.select(*kept, F.col("data"), F.col("linktype").cast("int").alias("__link")).mapInArrow(run, schema)
    own = local.select(F.col("ip").alias("__own")).distinct().withColumn("__is", F.lit(True))
    out = F.coalesce("__is", F.lit(False))
    sides = rows.join(own, rows["src"] == own["__own"], "left")
    side = lambda a, b: F.when(out, F.col(a)).otherwise(F.col(b))
    return sides.withColumns({"is_outgoing": out, "local_ip": side("src", "dst"), "remote_ip": side("dst", "src"), "local_port": side("src_port", "dst_port"), "remote_port": side("dst_port", "src_port"), "sender_ip": F.when(F.col("op").isNotNull(), F.col("src")), "target_ip": F.when(F.col("op").isNotNull(), F.col("dst"))}).drop("__own", "__is", "src", "dst", "src_port", "dst_port")
