"""Capture files as frames: a Spark data source for classic pcap and pcapng, and writers of both.

    spark.dataSource.register(PcapSource)
    spark.read.format("pcap").load("/captures")

A directory or file is read with one partition for each file. The files must lie
on storage that all executors mount; frames() reads any storage that Spark reads.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "frame_no long, ts_us long, orig_len long, linktype int, data binary"


def read_frames(raw: bytes, snaplen: int | None = None) -> Iterator[tuple]:
    """Frames of one capture file; what follows a cut or broken record is left out. Simple packets of pcapng have no time: ts_us is null."""
    if raw[:4] == b"\x0a\x0d\x0d\x0a":
        yield from _pcapng(raw, snaplen)
    elif len(raw) >= 24:
        magic = raw[:4]
        order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">" if magic in (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d") else None
        if order is None:
            return
        nanos = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
        link, at, n = struct.unpack_from(order + "I", raw, 20)[0] & 0xFFFF, 24, 0
        while at + 16 <= len(raw):
            sec, sub, kept, size = struct.unpack_from(order + "IIII", raw, at)
            if at + 16 + kept > len(raw):
                return
            yield n, sec * 1_000_000 + (sub // 1000 if nanos else sub), size, link, raw[at + 16 : at + 16 + kept][:snaplen]
            at, n = at + 16 + kept, n + 1


def _pcapng(raw: bytes, snaplen: int | None) -> Iterator[tuple]:
    at, n, order, links = 0, 0, "<", []
    while at + 12 <= len(raw):
        if raw[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, links = ("<" if raw[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", raw, at)
        if size < 12 or at + size > len(raw):
            return
        if kind == 1:
            per, shift, o = 1_000_000, 0, at + 16
            kind_of_link, most = struct.unpack_from(order + "HxxI", raw, at + 8)
            while o + 4 <= at + size - 4:
                code, length = struct.unpack_from(order + "HH", raw, o)
                if code == 0:
                    break
                if code == 9:
                    v = raw[o + 4]
                    per = 2 ** (v & 127) if v & 128 else 10**v
                if code == 14:
                    shift = struct.unpack_from(order + "q", raw, o + 4)[0]
                o += 4 + (length + 3) // 4 * 4
            links.append((kind_of_link, per, shift, most))
        elif kind in (2, 6) and size >= 32:  # packets; in the older form the interface has 16 bits, before a count of drops
            port, high, low, kept, whole = struct.unpack_from(order + ("HxxIIII" if kind == 2 else "IIIII"), raw, at + 8)
            link, per, shift, _ = links[port] if port < len(links) else (1, 1_000_000, 0, 0)
            yield n, (high << 32 | low) * 1_000_000 // per + shift * 1_000_000, whole, link, raw[at + 28 : at + 28 + min(kept, size - 32)][:snaplen]
            n += 1
        elif kind == 3 and size >= 16:  # a simple packet: of the first interface, without time
            whole = struct.unpack_from(order + "I", raw, at + 8)[0]
            link, _, _, most = links[0] if links else (1, 1_000_000, 0, 0)
            yield n, None, whole, link, raw[at + 12 : at + 12 + min(whole, most or whole, size - 16)][:snaplen]
            n += 1
        at += size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.snaplen = options["path"], int(options["snaplen"]) if options.get("snaplen") else None

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith((".pcap", ".pcapng", ".cap"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from read_frames(f.read(), self.snaplen)


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's binary file reader, one task for each file."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                yield pd.DataFrame(list(read_frames(bytes(raw))), columns=["frame_no", "ts_us", "orig_len", "linktype", "data"]).astype({"ts_us": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, FRAMES)


# -- writers -------------------------------------------------------------------


def pcap_header(linktype: int = 1, snaplen: int = 65535) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, linktype)


def pcap_record(us: int, data: bytes, size: int) -> bytes:
    return struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(data), size) + data


def pcapng_header(linktype: int = 1, snaplen: int = 65535) -> bytes:
    section = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    return section + struct.pack("<IIHHIHHB3xHHI", 1, 32, linktype, 0, snaplen, 9, 1, 6, 0, 0, 32)


def pcapng_record(us: int, data: bytes, size: int, comment: str | None) -> bytes:
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    note = comment.encode() if comment else b""
    options = struct.pack("<HH", 1, len(note)) + pad(note) + struct.pack("<HH", 0, 0) if note else b""
    body = struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), size) + pad(data) + options
    return struct.pack("<II", 6, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def write(rows: DataFrame, path: str, ng: bool = False) -> int:
    """Frames (ts_us, data, orig_len, linktype, comment) in time order to one file at the driver, streamed row by row; how many.

    A capture file is one ordered stream; rows come to the driver a partition at a
    time and are never held together.
    """
    n = 0
    with open(path, "wb") as out:
        for r in rows.orderBy("ts_us", "frame_no").toLocalIterator():
            if not n:
                out.write((pcapng_header if ng else pcap_header)(r["linktype"]))
            out.write(pcapng_record(r["ts_us"], bytes(r["data"]), r["orig_len"], r["comment"]) if ng else pcap_record(r["ts_us"], bytes(r["data"]), r["orig_len"]))
            n += 1
    return n
