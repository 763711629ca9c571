"""Capture filters against plain conditions."""

import pytest
from pyspark.sql import functions as F

from netquarry.operators import capture

ROWS = [
    (1, "TCP", "10.0.0.1", 4000, "203.0.113.9", 443, True, 100), (2, "TCP", "10.0.0.1", 4000, "203.0.113.9", 443, False, 900), (3, "UDP", "10.0.0.2", 53, "198.51.100.1", 5353, True, 60),
    (4, "UDP", "2001:db8::1", 5000, "2001:db8:0:1::9", 53, True, 70), (5, "ICMP", "2001:db8::1", 0, "fe80::1", 0, False, 80), (6, "ICMP", "10.0.0.1", 0, "8.8.8.8", 0, True, 90), (7, "ARP", "10.0.0.1", None, None, None, True, 42),
]
CASES = {
    "": [1, 2, 3, 4, 5, 6, 7], "tcp": [1, 2], "icmp": [6], "icmp6": [5], "ip6": [4, 5], "arp or icmp": [6, 7], "port 53": [3, 4], "src port 53": [3], "dst port 53 or 443": [1, 4], "udp port 53": [3, 4], "tcp port 53": [],
    "host 10.0.0.1": [1, 2, 6, 7], "src host 10.0.0.1": [1, 6, 7], "dst 10.0.0.1": [2], "net 203.0.113.0/24": [1, 2], "net 10.0.0.0/31": [1, 2, 6, 7], "net 2001:db8::/63": [4, 5], "net 2001:db8:0:1::/64": [4], "host 2001:0db8:0::1": [4, 5],
    "portrange 50-60": [3, 4], "not udp and not tcp": [5, 6, 7], "tcp or udp and less 65": [3], "tcp or (udp and less 65)": [1, 2, 3], "!(ip6 || arp) && greater 90": [1, 2, 6],
}


def test_filters_keep_what_they_say(spark):
    frame = spark.createDataFrame(ROWS, "n int, protocol string, local_ip string, local_port int, remote_ip string, remote_port int, is_outgoing boolean, packet_len int")
    found = frame.select("n", *(capture.compiled(text).alias(str(k)) for k, text in enumerate(CASES))).collect()
    assert {text: sorted(r["n"] for r in found if r[str(k)]) for k, text in enumerate(CASES)} == CASES


@pytest.mark.parametrize("text", ["port", "port http", "host", "10.0.0.1/33 or", "(tcp", "tcp)", "and tcp", "443", "host 10.0.0.0/8", "portrange 5", "less many", "tcp udp"])
def test_other_texts_are_errors(spark, text):
    with pytest.raises(ValueError):
        capture.compiled(text)
