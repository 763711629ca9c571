"""QUIC on the published test vectors of RFC 9001 and on packets made here."""

import random

from pyspark.sql import functions as F

from netquarry.operators import quic

# RFC 9001, appendix A: keys of the client id 8394c8f03e515708, the server's Initial and a Retry; the CRYPTO frame of A.2.
DCID = "8394c8f03e515708"
CLIENT = ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")
SERVER = ("cf3a5331653c364c88f0f379b6067e37", "0ac1493ca1905853b0bba03e", "c206b8d9b9f0f37644430b490eeaa314")
SERVER_INITIAL = "cf000000010008f067a5502a4262b5004075c0d95a482cd0991cd25b0aac406a5816b6394100f37a1c69797554780bb38cc5a99f5ede4cf73c3ec2493a1839b3dbcba3f6ea46c5b7684df3548e7ddeb9c3bf9c73cc3f3bded74b562bfb19fb84022f8ef4cdd93795d77d06edbb7aaf2f58891850abbdca3d20398c276456cbc42158407dd074ee"
RETRY = "ff000000010008f067a5502a4262b5746f6b656e04a265ba2eff4d829058fb3f0f2496ba"
CRYPTO = "060040f1010000ed0303ebf8fa56f12939b9584a3896472ec40bb863cfd3e86804fe3a47f06a2b69484c00000413011302010000c000000010000e00000b6578616d706c652e636f6dff01000100000a00080006001d0017001800100007000504616c706e000500050100000000003300260024001d00209370b2c9caa47fbabaf4559fedba753de171fa71f50f1ce15d43e994ec74d748002b0003020304000d0010000e0403050306030203080408050806002d00020101001c00024001003900320408ffffffffffffffff05048000ffff07048000ffff0801100104800075300901100f088394c8f03e51570806048000ffff"
HELLO = bytes.fromhex(CRYPTO)[4:]


def frame(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'binary'}" for k, v in values.items()))


def test_keys_of_the_published_example(spark):
    d = frame(spark, d=bytes.fromhex(DCID))
    keys = lambda version, side="client": tuple(bytes(x).hex() for x in quic.with_keys(d, F.col("d"), F.lit(version), side).select("__key", "__iv", "__hp").first())
    assert keys(1) == CLIENT
    assert keys(1, "server") == SERVER
    assert keys(quic.V2)[0] == "8b1a0bc121284290a29e0971b5cd045d"


def test_numbers_and_headers(spark):
    numbers = {"c2197c5eff14e88c": 1 << 30, "9d7f3e7d": 494878333, "7bbd": 15293, "25": 37, "40": None, "": None}
    rows = spark.createDataFrame([(bytes.fromhex(k),) for k in numbers], "d binary").select(quic.varint(F.col("d"), F.lit(0).cast("long")).alias("v")).collect()
    assert [r["v"] and r["v"]["value"] for r in rows] == list(numbers.values())
    data = {
        SERVER_INITIAL: [("Initial", 1, "")],
        RETRY: [("Retry", 1, "")],
        "80000000000401020304" + "00" + "00000001": [("Version Negotiation", 0, "01020304")],
        "c0000000010000c88c8c8c8c8c8c8c" + "00" * 20: [("Initial", 1, "")],
        "41" + "0102030405060708" + "00" * 20: [("1-RTT", 0, "0102030405060708")],
        "e000000001" + "0101" + "00" + "4003" + "aabbcc" + "41" + "11" * 20: [("Handshake", 1, "01"), ("1-RTT", 0, "11" * 8)],
        "00" * 30: [],
        "c000000001ff01": [],
        "d06b3343cf0101" + "00" + "00" + "4001" + "aa": [("Initial", quic.V2, "01")],
    }
    rows = spark.createDataFrame([(k, bytes.fromhex(data_)) for k, data_ in enumerate(data)], "k int, d binary").select("k", quic.coalesced(F.col("d")).alias("p")).collect()
    found = {r["k"]: [(p["head"]["kind"], p["head"]["version"], bytes(p["head"]["dcid"]).hex()) for p in r["p"]] for r in rows}
    assert [found[k] for k in range(len(data))] == list(data.values())


def test_published_packet_opens_and_other_bytes_do_not(spark):
    plain = bytes.fromhex(CRYPTO).ljust(1162, b"\0")
    raw = bytes(quic.protected(frame(spark, d=bytes.fromhex(DCID), p=plain), F.col("p"), F.col("d"), 1, F.lit(2)).first()["payload"])
    # the published packet: four bytes of packet number, protected first byte and number, and the first bytes of its payload
    assert raw[:22].hex() == "c000000001088394c8f03e5157080000449e7b9aec34" and raw[22:38].hex() == "d1b1c98dd7689fb8ec11d242b123dc9b"
    cases = [raw, raw[:-1] + bytes([raw[-1] ^ 1]), raw[:60], bytes.fromhex(SERVER_INITIAL)]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, x binary").withColumn("p", F.element_at(quic.coalesced(F.col("x")), 1))
    h = F.col("p.head")
    got = {r["k"]: r["plain"] and bytes(r["plain"]) for r in quic.opened(rows, F.col("p.raw"), h["dcid"], h["version"], h["number_at"]).collect()}
    assert got == {0: plain, 1: None, 2: None, 3: None}


def test_frames_are_walked(spark):
    ack = "02" + "4010" + "05" + "02" + "01" + "0101" + "0202"
    data = ("00" * 5 + "01" + ack + "03" + "10" + "00" + "00" + "01" + "010203" + "0600" + "03" + "616263" + "01" + "0604" + "02" + "6465" + "1c" + "00" + "06" + "00", "06" + "00" + "09" + "6162", "1d" + "05" + "02" + "6869", "7f00")
    rows = spark.createDataFrame([(k, bytes.fromhex(x)) for k, x in enumerate(data)], "k int, d binary").select("k", quic.frames(F.col("d")).alias("f")).collect()
    got = {r["k"]: ([(c["offset"], bytes(c["data"])) for c in r["f"]["crypto"]], r["f"]["close"], r["f"]["error"]) for r in rows}
    assert got == {0: ([(0, b"abc"), (4, b"de")], 0x1C, 0), 1: ([], None, None), 2: ([], 0x1D, 5), 3: ([], None, None)}


def test_fragments_in_any_order(spark):
    rng = random.Random(1)
    whole = bytes(rng.randrange(256) for _ in range(600))
    parts = [(k, whole[k : k + 100]) for k in range(0, 600, 100)]
    cases = [rng.sample(parts, 6), parts[:2] + parts[3:], [(50, b"x" * 100), *parts], [*parts, (0, b"y" * 700)], []]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, f array<struct<offset: bigint, data: binary>>").select("k", quic.assembled(F.col("f")).alias("b")).collect()
    assert [bytes(r["b"]) for r in sorted(rows)] == [whole, whole[:200], b"", whole, b""]


def datagrams(spark, specs):
    """specs: (remote port of the client's own side, us, dcid or raw bytes, packet number, plain payload)"""
    rows = [(k, us, port, bytes(d), n, bytes(plain) if plain is not None else None) for k, (port, us, d, n, plain) in enumerate(specs)]
    made = quic.protected(spark.createDataFrame(rows, "frame_no long, us long, local_port int, d binary, n long, plain binary"), F.col("plain"), F.col("d"), 1, F.col("n"))
    return made.select("frame_no", "us", F.lit("UDP").alias("protocol"), F.lit("10.0.0.1").alias("local_ip"), "local_port", F.lit("203.0.113.1").alias("remote_ip"), F.lit(443).alias("remote_port"), F.coalesce("payload", "d").alias("payload"))


def crypto(offset, data):
    return b"\x06" + (0x4000 | offset).to_bytes(2) + (0x4000 | len(data)).to_bytes(2) + data


def test_a_split_hello_and_a_migrated_connection_are_one_flow(spark):
    a, b, c = bytes(range(8)), bytes(range(8, 16)), bytes(range(16, 24))
    big = HELLO[:1] + (len(HELLO) - 4).to_bytes(3) + HELLO[4:]
    name = big.index(b"example.com")
    short = b"\x41" + bytes(30)
    specs = [
        (50000, 3, a, 2, crypto(120, big[120:]) + bytes(40)),
        (50000, 1, a, 0, crypto(0, big[:40])),
        (50001, 2, a, 1, bytes(9) + crypto(40, big[40:120])),  # the same connection from another port
        (50001, 4, short, 0, None),  # no id: it stays with its own addresses
        (50002, 1, b, 0, crypto(0, big)),
        (50002, 2, b, 1, b"\x1c\x00\x00\x00" + bytes(30)),
        (50003, 1, c, 0, crypto(name - 9, big[name - 9 : name + 20])),  # only the middle
        (50004, 1, b"\0not quic, but long enough to be", 0, None),
    ]
    found = {r["local_port"]: r for r in quic.flows(datagrams(spark, specs)).collect()}
    assert set(found) == {50000, 50001, 50002, 50003}
    assert (found[50000]["sni"], found[50000]["alpn"], found[50000]["state"], found[50000]["quic_packets"], bytes(found[50000]["dcid"])) == ("example.com", ["alpn"], "Initial", 3, a)
    assert (found[50001]["sni"], found[50001]["state"], found[50001]["kind"]) == (None, "Connected", "1-RTT")
    assert (found[50002]["sni"], found[50002]["state"], found[50002]["version"]) == ("example.com", "Draining", "v1")
    assert found[50003]["sni"] == "example.com"
    assert quic.flows(datagrams(spark, specs).limit(0)).count() == 0
