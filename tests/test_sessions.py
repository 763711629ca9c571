"""Generations told apart, SSH packets, united addresses, and timeouts by what a generation has shown."""

from pyspark.sql import functions as F

from netquarry.operators import decode, dpi, latency, lifecycle
from netquarry.plans.packets import FLOW

KEY = "protocol string, local_ip string, local_port int, remote_ip string, remote_port int"
A, B = ("TCP", "10.0.0.1", 1, "5.0.0.1", 443), ("TCP", "10.0.0.2", 1, "5.0.0.1", 443)


def test_rows_go_to_the_generation_they_fall_into(spark):
    found = spark.createDataFrame([(*A, 10, 20), (*A, 50, 60), (*B, 5, 5)], f"{KEY}, created_us long, last_us long")
    rows = spark.createDataFrame([(*A, us, us) for us in (9, 10, 20, 21, 50, 55, 61)] + [(*B, 5, 1), (*B, 6, 2)], f"{KEY}, us long, frame_no long")
    got = {(r.local_ip, r.us): r.created_us for r in lifecycle.assigned(rows, found).collect()}
    assert got == {("10.0.0.1", 10): 10, ("10.0.0.1", 20): 10, ("10.0.0.1", 50): 50, ("10.0.0.1", 55): 50, ("10.0.0.2", 5): 5}
    assert lifecycle.assigned(rows.where("false"), found).count() == 0


def test_a_generation_keeps_its_first_application(spark):
    packet = lambda us: (us * lifecycle.SECOND, True, 60, False, False, False, False, 0, 0, 0)
    flow = lifecycle.Flow()
    for us, app in ((0, None), (10, "DNS"), (20, "HTTP"), (30, None)):
        assert flow.packet(packet(us), "UDP", app) == []
    assert flow.live.application == "DNS"
    assert [g.closed_us for g in flow.packet(packet(61), "UDP", "HTTP")] == [60 * lifecycle.SECOND]  # 30 s behind the last packet
    assert flow.live.application == "HTTP"
    quic = lifecycle.Flow()
    for us, app in ((0, "QUIC_INITIAL"), (1, "QUIC_CONNECTED"), (2, "QUIC_HANDSHAKE")):
        quic.packet(packet(us), "UDP", app)
    assert quic.deadline("UDP") == 182 * lifecycle.SECOND


def test_ssh_packets(spark):
    rows = {
        "kex": ("000001000814", "KeyExchange"), "established": ("00000010045E", "Established"), "padding too short": ("000001000314", None), "padding too long": ("000000080714", None),
        "too short": ("000000070414", None), "too long": ("000088B90414", None), "longest": ("000088B80414", "KeyExchange"), "ignore": ("000001000802", "Banner"), "unknown": ("00000100081E", None),
        "behind a banner": ("5353482D322E302D610A" + "000000100634", "Established"), "overlapping": ("5353482D322E302D6100" + "0000001004" + "32", "Authentication"), "short": ("0000", None), "empty": ("", None),
    }
    data = spark.createDataFrame([(n, h) for n, (h, _) in rows.items()], "name string, h string").select("name", F.unhex("h").alias("d"))
    got = {r.name: r.state for r in data.select("name", decode.ssh(F.col("d"), F.decode("d", "iso-8859-1"))["state"].alias("state")).collect()}
    assert got == {n: s for n, (_, s) in rows.items()}


def test_addresses_are_united_to_a_bound_and_packets_counted_once(spark):
    fields = "app string, " + ", ".join(f"{n} string" for n in dpi.TEXT_FIELDS) + ", kind string, version string, code int, is_response boolean, ips array<string>, alpn array<string>, cipher int, txid string, algorithms array<string>, transmit string"
    names = [f.strip().split(" ")[0] for f in fields.split(", ")]
    answer = lambda ips: tuple({"app": "DNS", "ips": ips, "is_response": bool(ips)}.get(n) for n in names)
    rows = [(*A, k, k, k % 2 == 0, 100, answer([f"1.0.0.{k}", f"1.0.0.{k + 1}", "1.0.0.0"] if k % 3 else [])) for k in range(99)]
    rows += [(*A, 200, 200, True, 7, None), (*B, 0, 0, False, 5, None)]
    seen = spark.createDataFrame(rows, f"{KEY}, us long, frame_no long, is_outgoing boolean, packet_len long, dpi struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>")
    got = {r.local_ip: r for r in dpi.connections(seen).collect()}
    wanted = list(dict.fromkeys(ip for k in range(99) if k % 3 for ip in (f"1.0.0.{k}", f"1.0.0.{k + 1}", "1.0.0.0")))
    one = got["10.0.0.1"]
    assert one.dpi.ips == wanted[: dpi.MOST_LISTED] and one.dpi.is_response
    assert (one.packets, one.bytes_sent, one.bytes_received) == (100, 5007, 4900)
    assert got["10.0.0.2"].dpi is None and got["10.0.0.2"].bytes_received == 5


def test_latencies_age_and_loopback(spark):
    rows = [
        (*("ICMP", "127.0.0.1", 0, "127.0.0.1", 0), 0, 0, True, 8, 1, 1), (*("ICMP", "127.0.0.1", 0, "127.0.0.1", 0), 30, 1, True, 0, 1, 1),
        (*("ICMP", "10.0.0.1", 0, "5.0.0.1", 0), 0, 2, True, 8, 1, 1), (*("ICMP", "10.0.0.1", 0, "5.0.0.1", 0), 10_000_000, 3, False, 0, 1, 1),
        (*("ICMP", "10.0.0.1", 0, "5.0.0.2", 0), 0, 4, True, 8, 1, 1), (*("ICMP", "10.0.0.1", 0, "5.0.0.2", 0), 9_999_999, 5, False, 0, 1, 1), (*("ICMP", "10.0.0.1", 0, "5.0.0.2", 0), 9_999_999, 6, False, 0, 1, 1),
    ]
    seen = spark.createDataFrame(rows, f"{KEY}, us long, frame_no long, is_outgoing boolean, icmp_type int, icmp_id int, icmp_seq int")
    none = "struct<app:string,kind:string,command:string,is_response:boolean,txid:string,transmit:string>"
    whole = seen.withColumns({"syn": F.lit(None).cast("boolean"), "ack_flag": F.lit(None).cast("boolean"), "dpi": F.lit(None).cast(none)})
    assert sorted((r.remote_ip, r.latency_us) for r in latency.measured(whole).select(*FLOW, "latency_us").collect()) == [("127.0.0.1", 30), ("5.0.0.2", 9_999_999)]
