"""Capture files, frames and dissectors on known inputs."""

import struct

from pyspark.sql import functions as F

from netquarry.operators import decode
from netquarry.sources import pcap

MACS = bytes.fromhex("020000000001020000000002")


def ip4(proto, body, src=(10, 0, 0, 1), dst=(203, 0, 113, 9)):
    return MACS + b"\x08\x00" + struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, *src, *dst) + body


def ip6(proto, body, src, dst):
    return MACS + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), proto, 64) + bytes.fromhex(src) + bytes.fromhex(dst) + body


UDP = struct.pack(">HHHH", 40000, 53, 12, 0) + b"abcd"
TCP = struct.pack(">HHIIBBHHH", 443, 41000, 7, 9, 0x50, 0x12, 512, 0, 0) + b"hello"
ARP = MACS + b"\x08\x06" + bytes.fromhex("0001080006040001" + "0200000000010a000001" + "000000000000cb007109")
FRAMES = [ip4(17, UDP), ip4(6, TCP, (203, 0, 113, 9), (10, 0, 0, 1)), ARP, ip6(17, UDP, "20010db8" + "00" * 11 + "01", "fe80" + "00" * 14), b"short", ip4(17, UDP)[:36]]


def test_capture_files_round_trip(spark, tmp_path):
    rows = [(k, 1_000_000 + k, len(f), 1, bytearray(f), "process=a" if k else None) for k, f in enumerate(FRAMES)]
    frames = spark.createDataFrame(rows, "frame_no long, ts_us long, orig_len long, linktype int, data binary, comment string")
    for ng, name in ((False, "one.pcap"), (True, "two.pcapng")):
        assert pcap.write(frames, f"{tmp_path}/{name}", ng) == len(rows)
        got = pcap.frames(spark, f"{tmp_path}/{name}").orderBy("frame_no").collect()
        assert [(r["frame_no"], r["ts_us"], r["orig_len"], r["linktype"], r["data"]) for r in got] == [r[:5] for r in rows]
    spark.dataSource.register(pcap.PcapSource)
    assert spark.read.format("pcap").load(str(tmp_path)).count() == 2 * len(rows)


def test_frames_become_packets(spark):
    frames = spark.createDataFrame([(k, 1, bytearray(f)) for k, f in enumerate(FRAMES)], "frame_no long, linktype int, data binary")
    local = spark.createDataFrame([("10.0.0.1",), ("2001:db8::1",)], "ip string")
    got = {r["frame_no"]: r for r in decode.packets(frames, local).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    udp, tcp, arp, six = (got[k] for k in range(4))
    assert (udp["protocol"], udp["is_outgoing"], udp["local_port"], udp["remote_port"], udp["payload"]) == ("UDP", True, 40000, 53, b"abcd")
    assert (tcp["protocol"], tcp["is_outgoing"], tcp["syn"], tcp["ack_flag"], tcp["fin"], tcp["seq"], tcp["payload_len"]) == ("TCP", False, True, True, False, 7, 5)
    assert (arp["protocol"], arp["op"], arp["sender_ip"], arp["target_ip"], arp["sender_mac"]) == ("ARP", "request", "10.0.0.1", "203.0.113.9", "02:00:00:00:00:01")
    assert (six["local_ip"], six["remote_ip"], six["is_outgoing"]) == ("2001:db8::1", "fe80::", True)


def six(first, chain, src="20010db8" + "00" * 11 + "01", dst="fe80" + "00" * 14, hop=64, length=None):
    return MACS + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(chain) if length is None else length, first, hop) + bytes.fromhex(src) + bytes.fromhex(dst) + chain


def test_links_extension_headers_and_neighbours(spark):
    option = bytes([2, 1]) + bytes.fromhex("0a0b0c0d0e0f")
    advert = bytes([136, 0, 0, 0, 0, 0, 0, 0]) + bytes.fromhex("fe80" + "00" * 13 + "07")
    many = {
        "hop by hop": six(0, bytes([17, 0]) + bytes(6) + UDP),
        "routing, destination": six(43, bytes([60, 0]) + bytes(6) + bytes([17, 1]) + bytes(14) + UDP),
        "first fragment": six(44, bytes([17, 0, 0, 1, 0, 0, 0, 9]) + UDP),
        "later fragment": six(44, bytes([17, 0, 0, 9, 0, 0, 0, 9]) + UDP),
        "authentication": six(51, bytes([17, 1]) + bytes(10) + UDP),
        "encrypted": six(50, UDP),
        "no payload length": six(17, UDP, length=0),
        "neighbour": six(58, advert + option, hop=255),
        "neighbour from afar": six(58, advert + option, hop=64),
        "malformed option": six(58, advert + option + b"\x01", hop=255),
        "tagged": MACS + b"\x81\x00\x00\x05" + ip4(17, UDP)[12:],
    }
    others = {"null": (0, bytes(4) + ip4(17, UDP)[14:]), "raw": (101, ip4(17, UDP)[14:]), "cooked": (113, bytes(14) + ip4(17, UDP)[12:]), "cooked, tagged": (113, bytes(14) + b"\x81\x00\x00\x05" + ip4(17, UDP)[12:]), "cooked 2": (276, b"\x08\x00" + bytes(18) + ip4(17, UDP)[14:])}
    rows = [(n, 1, bytearray(f)) for n, f in many.items()] + [(n, k, bytearray(f)) for n, (k, f) in others.items()] + [("null row", 1, None), ("empty", 1, bytearray())]
    frames = spark.createDataFrame(rows, "name string, linktype int, data binary")
    got = {r["name"]: r for r in decode.packets(frames, spark.createDataFrame([], "ip string")).collect()}
    assert set(got) == {*many, *others} - {"later fragment", "encrypted"}
    assert {r["payload"] for n, r in got.items() if "neighbour" not in n and n != "malformed option"} == {b"abcd"}
    assert (got["neighbour"]["ndp_ip"], got["neighbour"]["ndp_mac"]) == ("fe80::7", "0a:0b:0c:0d:0e:0f")
    assert got["neighbour from afar"]["ndp_mac"] is None and got["malformed option"]["ndp_mac"] is None
    some = decode.packets(frames, spark.createDataFrame([], "ip string"), protocols=("ICMP",))
    assert {r["protocol"] for r in some.collect()} == {"ICMP"}
    assert decode.packets(frames, spark.createDataFrame([], "ip string"), ports=(54,)).count() == 0


def one(spark, column, value, kind="binary"):
    value = bytearray(value) if kind == "binary" else value
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first()["r"]


def test_dissectors(spark):
    x = F.col("x")
    assert one(spark, decode.http(x), "GET / HTTP/7.3\r\n", "string") is None and one(spark, decode.http(x), "HTTP/2 200\r\n", "string")["status"] == 200
    assert one(spark, decode.ftp(x), "220-Welcome to us\r\n", "string")["software"] is None and one(spark, decode.ftp(x), "220 ProFTPD 1.3.7 ready\r\n", "string")["software"] == "ProFTPD"
    assert one(spark, decode.ftp(x), "215 UNIX Type: L8\r\n", "string")["system"] == "UNIX"
    assert one(spark, decode.http(x), "GET /index.html HTTP/1.1\r\nHost: example.com\r\n\r\n", "string")["host"] == "example.com"
    assert one(spark, decode.http(x), "INVITE sip:a SIP/2.0\r\n", "string") is None
    assert one(spark, decode.ssdp(x), "M-SEARCH * HTTP/1.1\r\nST: ssdp:all\r\n\r\n", "string")["target"] == "ssdp:all"
    query = bytes.fromhex("abcd01000001000000000000") + b"\x07example\x03com\x00" + bytes.fromhex("00010001")
    answer = bytes.fromhex("abcd81800001000100000000") + query[12:] + bytes.fromhex("c00c000100010000003c00045db8d822")
    assert one(spark, decode.dns(x), query)["name"] == "example.com"
    assert one(spark, decode.dns(x), answer)["ips"] == ["93.184.216.34"]
    assert one(spark, decode.dns(x), b"\xab") ["name"] is None
    stun = bytes.fromhex("010100002112a442") + bytes(range(12))
    assert one(spark, decode.stun(x), stun)["class"] == "Success"
    assert one(spark, decode.ntp(x), bytes([0x23]) + bytes(47))["mode"] == 3


def test_offloaded_frames_and_taught_neighbours(spark):
    from netquarry.operators import aggregates

    offloaded = bytearray(ip4(6, TCP, (203, 0, 113, 9), (10, 0, 0, 1)))
    offloaded[16:18] = b"\0\0"  # total length 0: the card cuts the segments
    option = bytes([2, 1]) + bytes.fromhex("0a0b0c0d0e0f")
    advert = bytes([136, 0, 0, 0, 0, 0, 0, 0]) + bytes.fromhex("fe80" + "00" * 13 + "07")
    grouped = bytes([136, 0, 0, 0, 0, 0, 0, 0]) + bytes.fromhex("ff02" + "00" * 13 + "01")
    many = [bytes(offloaded), six(58, advert + option, hop=255), six(58, grouped + option, hop=255), ARP]
    rows = spark.createDataFrame([(k, k, 1, bytearray(f)) for k, f in enumerate(many)], "frame_no long, us long, linktype int, data binary")
    found = decode.packets(rows, spark.createDataFrame([("10.0.0.1",)], "ip string"))
    first = found.where("frame_no = 0").first()
    assert (first["payload"], first["payload_len"], first["packet_len"]) == (b"hello", 5, len(offloaded))
    assert {(r["ip"], r["mac"]) for r in aggregates.neighbours(found).collect()} == {("fe80::7", "0a:0b:0c:0d:0e:0f"), ("10.0.0.1", "02:00:00:00:00:01")}


def element(kind, body):
    size = len(body)
    return bytes([kind]) + (bytes([size]) if size < 128 else b"\x82" + size.to_bytes(2)) + body


def test_snmp_messages(spark):
    pdu = lambda tag: element(tag, element(2, b"\x01"))
    old = lambda version, name, tag: element(0x30, element(2, bytes([version])) + element(4, name) + pdu(tag))
    scope = element(0x30, element(4, b"engine") + element(4, b"") + pdu(0xA8))
    third = lambda data: element(0x30, element(2, b"\x03") + element(0x30, element(2, b"\x07") * 3) + element(4, b"x" * 200) + data)
    many = {
        old(0, b"public", 0xA4): ("v1", "public", "TRAP"), old(1, b"private", 0xA5): ("v2c", "private", "GETBULK"), old(1, b"\xff\xfe", 0xA2): ("v2c", None, "RESPONSE"), old(1, b"c" * 300, 0xA0): ("v2c", "c" * 300, "GET"),
        third(scope): ("v3", None, "REPORT"), third(element(4, b"secret")): ("v3", None, "ENCRYPTED"), third(element(2, b"\x01")): None, old(2, b"public", 0xA0): None, old(1, b"public", 0x30): None, old(1, b"public", 0xA0)[:-3]: None,
        b"\x30\x80" + bytes(20): None, b"\x30\x01\x02": None, b"": None,
    }
    rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(many)], "k int, d binary").select("k", decode.snmp(F.col("d")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in sorted(rows)] == list(many.values())


def encoded(name, suffix=0):
    raw = name.ljust(15).encode() + bytes([suffix])
    return b"\x20" + bytes(x for b in raw for x in (65 + (b >> 4), 65 + (b & 15)))


def test_netbios_names_and_datagrams(spark):
    head = lambda flags: b"\x12\x34" + flags.to_bytes(2) + bytes(8)
    names = {head(0x0110) + encoded("DESKTOP"): ("NS", "Query", "DESKTOP", 0x1234, False, None), head(0xBC00) + encoded("WAIT"): ("NS", "WACK", "WAIT", 0x1234, False, None), head(0x8503) + encoded("GONE", 0x1B): ("NS", "Response", "GONE", 0x1234, True, 3), head(0x2910): ("NS", "Register", None, 0x1234, False, None), head(0x4800) + b"\x20" + b"zz" * 16: ("NS", "Unknown(9)", None, 0x1234, False, None), b"short": None}
    rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(names)], "k int, d binary").select("k", decode.netbios_names(F.col("d")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in sorted(rows)] == list(names.values())
    grams = {b"\x11\x02\x00\x09" + bytes(10) + encoded("MAIL"): ("DGM", "Datagram", "MAIL", 9, False, None), b"\x16\x02\x00\x09" + bytes(6) + encoded("NO"): ("DGM", "Response", "NO", 9, True, None), b"\x13\x02\x00\x09" + bytes(7): ("DGM", "Error", None, 9, False, None), b"\x10\x02" + bytes(6): None, b"\x77\x02\x00\x09" + bytes(6): ("DGM", "Unknown(119)", None, 9, False, None)}
    rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(grams)], "k int, d binary").select("k", decode.netbios_datagrams(F.col("d")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in sorted(rows)] == list(grams.values())


def test_bittorrent_peers_dht_and_utp(spark):
    shake = lambda peer, flags=bytes(8): b"\x13BitTorrent protocol" + flags + b"\xab" * 20 + peer.ljust(20, b"x")
    peers = {shake(b"-qB4250-", b"\0\0\0\0\0\x10\0\x05"): ("ab" * 20, "qBittorrent 4.2.5.0", True, True, True), shake(b"-ZZ10a!-"): ("ab" * 20, "ZZ 1.0.a", False, False, False), shake(b"M7-9-2--"): ("ab" * 20, "Mainline", False, False, False), shake(b"?"): ("ab" * 20, None, False, False, False), b"\x13BitTorrent protocol": (None, None, False, False, False), b"GET /": None}
    rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(peers)], "k int, d binary").select("k", decode.bittorrent(F.col("d")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in sorted(rows)] == list(peers.values())
    utp = lambda first, number, window: bytes([first, 0]) + number.to_bytes(2) + bytes(8) + window.to_bytes(4) + bytes(4)
    udp = {b"d1:ad2:id2:xxe1:q9:get_peers1:t2:aa1:y1:qe": ("DHT", "get_peers"), b"d1:rd2:id2:xxe1:t2:aa1:y1:re": ("DHT", "response"), b"d1:eli201e1:xe1:t2:aa1:y1:ee": ("DHT", "error"), b"d1:q99:ping1:y1:qe": ("DHT", None), b"d1:t2:aae": None, utp(0x41, 7, 1): ("uTP", None), utp(0x31, 7, 0): ("uTP", None), utp(0x01, 7, 0): None, utp(0x01, 0, 1): None, utp(0x51, 7, 1): None}
    rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(udp)], "k int, d binary").select("k", decode.bittorrent_udp(F.col("d")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in sorted(rows)] == list(udp.values())
