"""Counters, comments, reports and the rarer blocks of capture files, with absent, odd and repeated values."""

import struct

from pyspark.sql import functions as F

from netquarry.sinks import events
from netquarry.sources import dimensions, pcap


def test_counters_of_whole_readings(spark):
    path = "/sys/class/net/{}/statistics/{}".format
    rows = [(path("eth0", c), f" {k}\n", 5) for k, c in enumerate(dimensions.COUNTERS)]
    rows += [(path("lo", c), "9223372036854775807" if c == "rx_bytes" else "+1", 5) for c in dimensions.COUNTERS]
    rows += [(path("big", c), "9223372036854775808", 5) for c in dimensions.COUNTERS]
    rows += [(path("part", c), "1", 5) for c in dimensions.COUNTERS[1:]] + [(path("odd", c), "-1", 5) for c in dimensions.COUNTERS]
    rows += [(path("eth0", "rx_bytes"), "7", 5), (path("eth0", "carrier"), "1", 5), (path("never", "rx_bytes"), "1", None), (None, "1", 5), (path("none", "rx_bytes"), None, 5), ("notes.txt", "1", 5)]
    files = spark.createDataFrame(rows, "path string, value string, ts_us long").withColumn("interface_name", F.lit("clash"))
    got = {r["interface_name"]: tuple(r[c] for c in dimensions.COUNTERS) for r in dimensions.counters(files).collect()}
    assert got == {"eth0": tuple(range(9)), "lo": (2**63 - 1, *[1] * 8)}
    assert dimensions.counters(files.limit(0)).count() == 0


def test_comments_show_what_is_there(spark):
    kind = "struct<pod_name: string, pod_namespace: string, pod_uid: string, container_name: string, container_id: string>"
    rows = [
        ("a b", 7, 1, 0, "exact", ("web", "shop", "u", "c", "d"), True, "HTTPS", "x.example", "DE", 64500),
        (None, None, None, None, None, None, None, None, "x.example", None, None),
        ("\t", None, None, None, None, (None, "shop", None, None, None), False, "DNS", None, None, 0),
    ]
    table = spark.createDataFrame(rows, f"process_name string, pid long, process_ppid long, process_uid long, attribution_match string, kubernetes {kind}, connection_direction boolean, application string, dpi_domain string, geoip_country_code string, geoip_asn long")
    got = [r[0] for r in table.select(events.connection_comment(table)).collect()]
    assert got[0] == "flow process=a_b pid=7 ppid=1 uid=0 attr=exact pod=web ns=shop pod_uid=u container=c container_id=d direction=outgoing app=HTTPS sni=x.example country=DE asn=64500"
    assert got[1] is None and got[2] == "flow ns=shop direction=incoming app=DNS asn=0"
    few = table.select("pid")
    assert [r[0] for r in few.select(events.connection_comment(few, "tool")).collect()] == ["tool pid=7", None, None]


def test_report_lines(spark):
    kind = "frame long, time double, proto string, src string, dst string, country string, city string, postal_code string, asn long, as_org string, pid long, process string"
    rows = [(1, 1.5, "TCP", "10.0.0.1:40000", "[2001:db8::1:2:3:4:5]:443", "DE", "Frankfurt am Main", "60311", 64500, "Net", 7, "x" * 16), (1234567, 0.0, "UDP", "a", "b", None, None, None, 0, None, None, None)]
    packets = spark.createDataFrame(rows, kind)
    tabs, table = ({r["frame"]: r["value"] for r in f(packets).collect()} for f in (events.tab_lines, events.table_lines))
    assert tabs[1].split("\t") == ["1", "1.500000", "TCP", "10.0.0.1:40000", "[2001:db8::1:2:3:4:5]:443", "DE", "Frankfurt am Main", "60311", "64500", "Net", "7", "x" * 16]
    assert tabs[1234567].split("\t") == ["1234567", "0.000000", "UDP", "a", "b", *[""] * 7]
    assert table[1] == f"{1:>6} {'TCP':<5} {'10.0.0.1:40000':<22} {'[2001:db8::1:2:3:4:5]:'[:22]:<22} {'DE':<4} {'Frankfurt am...':<15} {'AS64500':>8} {7:>7} {'x' * 12 + '...':<15}"
    assert table[1234567] == f"1234567 {'UDP':<5} {'a':<22} {'b':<22} {'-':<4} {'-':<15} {'-':>8} {'-':>7} {'-':<15}"
    assert events.tab_lines(packets.limit(0)).count() == 0


def test_connections_count_once_from_either_end(spark):
    rows = [("a", "b", "TCP", 1, 5), ("b", "a", "TCP", 1, 5), ("a", "b", "UDP", 1, 5), ("a", "b", "TCP", 2, 5), ("a", "b", "TCP", 1, None), ("b", "a", "TCP", 1, None), (None, "a", "TCP", 1, 5), ("a", None, "TCP", 1, 5)]
    lines = spark.createDataFrame(rows, "src string, dst string, protocol string, first_us long, pid long")
    assert events.unique_connections(lines, ["src", "dst", "protocol"]).first()["connections"] == 5
    assert events.unique_connections(lines.limit(0), ["src", "dst", "protocol"]).first()["connections"] == 0


def test_simple_and_older_packet_blocks_and_time_offsets(spark, tmp_path):
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    interface = block(1, struct.pack("<HHI", 101, 0, 6) + struct.pack("<HHq", 14, 8, 100) + struct.pack("<HHB3x", 9, 1, 3) + struct.pack("<HH", 0, 0))
    older = block(2, struct.pack("<HHIIII", 0, 9, 0, 2500, 4, 60) + b"abcd")
    simple = block(3, struct.pack("<I", 60) + b"efghij\0\0")
    whole = block(6, struct.pack("<IIIII", 0, 0, 1000, 3, 3) + b"xyz\0")
    (tmp_path / "one.pcapng").write_bytes(section + interface + older + simple + block(0xBAD, b"") + whole + whole[:20])
    wanted = [(0, 102_500_000, 60, 101, b"abcd"), (1, None, 60, 101, b"efghij"), (2, 101_000_000, 3, 101, b"xyz")]
    got = pcap.frames(spark, f"{tmp_path}/one.pcapng").orderBy("frame_no").collect()
    assert [(r["frame_no"], r["ts_us"], r["orig_len"], r["linktype"], bytes(r["data"])) for r in got] == wanted
    spark.dataSource.register(pcap.PcapSource)
    assert spark.read.format("pcap").load(str(tmp_path)).where("ts_us is null").count() == 1
