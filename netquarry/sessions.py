"""Registered queries of whole sessions: frames and dissected packets made from the pages table, through the plans that users call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.catalog import query
from netquarry.inspection import _hello, _hex, _label, _text
from netquarry.operators import dpi, latency
from netquarry.plans import observed
from netquarry.plans.packets import FLOW, table

_IP = "'{}.' || (n // 62500) % 250 || '.' || (n // 250) % 250 || '.' || n % 250"
S = f"with s as (select n, {_IP.format(10)} as local_ip, {_IP.format(5)} as remote_ip, 'h' || n || '.example.com' as host from (select page_id as n from pages where page_id is not null))"


def _n() -> Column:
    """The page's number; made when a query runs, as columns need a session."""
    return F.col("page_id")


def _octets(first: int) -> list[Column]:
    return [F.lit(first), *(F.floor(_n() / 250**e) % 250 for e in (2, 1, 0))]


def _ip(first: int) -> Column:
    return F.concat_ws(".", *(c.cast("string") for c in _octets(first)))


def _steps(spark: SparkSession, d: str, names: str, rows: list[tuple]) -> DataFrame:
    """Every page with each of the steps that its page_id takes; a step's values are columns or literals."""
    one = lambda r: F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names.split(), r)))
    pages = table(spark, d, "pages").where(_n().isNotNull()).select("page_id", F.explode(F.array(*map(one, rows))).alias("s"))
    return pages.select("page_id", "s.*").where("taken").withColumn("frame_no", _n() * 16 + F.col("step"))


# -- frames to connections -------------------------------------------------------


def _wait() -> Column:
    return F.lit(5000) + _n() % 7 * 1000


def _session_frames(spark: SparkSession, d: str) -> DataFrame:
    """A name lookup; a connection that asks by HTTP or TLS and ends by a FIN from either side or an RST; and for every fifth page a late second SYN of the same ports."""
    host = F.concat(_label(_n()), F.lit(".example.com"))
    name = F.concat(_hex(F.length(_label(_n())), 1), _text(_label(_n())), F.lit("076578616D706C6503636F6D00"))
    hello = F.concat(F.lit("160301"), _hex(F.length(host) + 65, 2), _hello(host))
    request = _text(F.concat(F.lit("GET /p"), _n().cast("string"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    ask = F.concat(_hex(_n() % 65536, 2), F.lit("01000001000000000000"), name, F.lit("00010001"))
    answer = F.concat(_hex(_n() % 65536, 2), F.lit("81800001000100000000"), name, F.lit("00010001" + "C00C000100010000003C0004"), *(_hex(c, 1) for c in _octets(5)))
    said = F.when(_n() % 2 == 0, request).otherwise(hello)
    size, end = F.length(said) / 2, _n() % 3
    rows = [  # step, time, outgoing, over UDP, sequence number, acknowledged, flags, payload, taken
        (0, F.lit(0), True, True, F.lit(0), F.lit(0), 0, ask, True),
        (1, 2000 + _n() % 5 * 1000, False, True, F.lit(0), F.lit(0), 0, answer, True),
        (2, F.lit(20_000), True, False, F.lit(1000), F.lit(0), 0x02, F.lit(""), True),
        (3, 20_000 + _wait(), False, False, F.lit(5000), F.lit(1001), 0x12, F.lit(""), True),
        (4, 20_100 + _wait(), True, False, F.lit(1001), F.lit(5001), 0x18, said, True),
        (5, 25_100 + _wait(), False, False, F.lit(5001), 1001 + size, 0x10, F.lit(""), True),
        (6, F.lit(50_000), True, False, 1001 + size, F.lit(5001), 0x11, F.lit(""), end == 0),
        (7, F.lit(50_000), False, False, F.lit(5001), 1001 + size, 0x11, F.lit(""), end == 1),
        (8, F.lit(50_000), False, False, F.lit(5001), F.lit(0), 0x04, F.lit(""), end == 2),
        (9, F.lit(30_050_000), True, False, F.lit(9000), F.lit(0), 0x02, F.lit(""), _n() % 5 == 0),
    ]
    rows = [(k, at.cast("long"), out, udp, seq.cast("long"), ack.cast("long"), flags, data, taken) for k, at, out, udp, seq, ack, flags, data, taken in rows]
    sent = _steps(spark, d, "step at out udp seq ack flags data taken", rows)
    udp, out, hexed = F.col("udp"), F.col("out"), lambda cs: F.concat(*(_hex(c, 1) for c in cs))
    there = F.when(udp, "0AFFFF35").otherwise(hexed(_octets(5)))
    here, port, other = hexed(_octets(10)), F.when(udp, 50000).otherwise(40000), F.when(udp, 53).when(_n() % 2 == 0, 80).otherwise(443)
    ways = lambda a, b: F.concat(F.when(out, a).otherwise(b), F.when(out, b).otherwise(a))
    ends = ways(_hex(port, 2), _hex(other, 2))
    count = F.length("data") / 2
    l4 = F.when(udp, F.concat(ends, _hex(count + 8, 2), F.lit("0000"))).otherwise(F.concat(ends, _hex(F.col("seq"), 4), _hex(F.col("ack"), 4), F.lit("50"), _hex(F.col("flags"), 1), F.lit("200000000000")))
    ip = F.concat(F.lit("4500"), _hex(count + F.when(udp, 28).otherwise(40), 2), F.lit("0000000040"), F.when(udp, "11").otherwise("06"), F.lit("0000"), ways(here, there))
    return sent.select("frame_no", (_n() * 1_000_000 + F.col("at")).alias("us"), F.lit(1).alias("linktype"), F.unhex(F.concat(F.lit("0200000000010200000000020800"), ip, l4, F.col("data"))).alias("data"))


_TCP = "select n, 'TCP' as protocol, local_ip, 40000 as local_port, remote_ip, case when n % 2 = 0 then 80 else 443 end as remote_port"
_SENT = "case when n % 2 = 0 then length('GET /p' || n || ' HTTP/1.1') + length('Host: ' || host) + 6 else length(host) + 70 end"


@query("fl1_whole", S + f""", w as (select *, n * 1000000 as t, 5000 + n % 7 * 1000 as d, {_SENT} as size from s), g as (
select 'UDP' as protocol, local_ip, 50000 as local_port, '10.255.255.53' as remote_ip, 53 as remote_port, t as created_us, null::bigint as closed_us, null as close_reason, 'DNS_RESPONSE' as shown_state, 'DNS (' || host || ')' as application, null::bigint as rtt_us, 2000 + n % 5 * 1000 as response_us, null as hostname, 'domain' as service_name,
  null::bigint as pid, 'unspecified' as quality, 1 as packets_sent, 1 as packets_received, null::bigint as srtt_us, length(host) + 60 as bytes_sent from w
union all select 'TCP', local_ip, 40000, remote_ip, case when n % 2 = 0 then 80 else 443 end, t + 20000, case when n % 5 <> 0 then null when n % 3 = 2 then t + 15050000 else t + 30050000 end, case when n % 5 = 0 then case when n % 3 = 2 then 'timeout' else 'new_generation' end end,
  ['FIN_WAIT1', 'CLOSE_WAIT', 'CLOSED'][n % 3 + 1], case when n % 2 = 0 then 'HTTP (' else 'HTTPS (' end || host || ')', d, null, host, case when n % 2 = 0 then 'http' else 'https' end,
  case when n % 4 = 0 then n end, case when n % 4 = 0 then 'procfs-exact' else 'unspecified' end, 2 + (n % 3 = 0)::int, 2 + (n % 3 <> 0)::int, 5000, 108 + size + case when n % 3 = 0 then 54 else 0 end from w
union all select 'TCP', local_ip, 40000, remote_ip, case when n % 2 = 0 then 80 else 443 end, t + 30050000, null, null, 'SYN_SENT', null, null, null, null, case when n % 2 = 0 then 'http' else 'https' end, case when n % 4 = 0 then n end, case when n % 4 = 0 then 'procfs-exact' else 'unspecified' end, 1, 0, null, 54 from w where n % 5 = 0) select * from g""")
def fl1_whole(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where(_n().isNotNull())
    services = spark.createDataFrame([("tcp", 80, "http"), ("tcp", 443, "https"), ("udp", 53, "domain")], "protocol string, port int, name string")
    port = F.when(_n() % 2 == 0, 80).otherwise(443)
    sockets = pages.where(_n() % 4 == 0).select(F.lit("TCP").alias("protocol"), _ip(10).alias("local_ip"), F.lit(40000).alias("local_port"), _ip(5).alias("remote_ip"), port.alias("remote_port"), _n().alias("pid"), F.lit("p").alias("name"))
    rows = observed.connections(_session_frames(spark, d), pages.select(_ip(10).alias("ip")), services, sockets)
    return rows.select(*FLOW, "created_us", "closed_us", "close_reason", "shown_state", "application", F.col("rtt_us").cast("long"), F.col("response_us").cast("long"), "hostname", "service_name", F.col("pid").cast("long"), "quality", F.col("packets_sent").cast("int"), F.col("packets_received").cast("int"), "srtt_us", "bytes_sent")


# -- latencies of dissected packets ----------------------------------------------

#: kind, protocol, local port, remote port, whether this host asks, whether another address answers than was asked
EXCHANGES = [("dns", "UDP", 40000, 53, True, False), ("llmnr", "UDP", 40000, 5355, True, True), ("netbios", "UDP", 137, 137, True, True), ("icmp", "ICMP", 0, 0, True, False), ("stun", "UDP", 40000, 3478, True, False), ("ntp", "UDP", 40000, 123, True, False), ("quic", "UDP", 40000, 443, True, False), ("handshake", "TCP", 443, 40000, False, False)]


def _exchanges(spark: SparkSession, d: str) -> DataFrame:
    """A request a page, sent again after 1 ms by every third, and its answer: none for every fifth, after 40 s for every seventh."""
    question = F.concat(_hex(F.length(_label(_n())), 1), _text(_label(_n())), F.lit("00" + "00010001"))
    txid, late = _hex(_n() % 65536, 2), F.when(_n() % 7 == 0, 40_000_000).otherwise(3000 + _n() % 11 * 100)
    rows = [(0, F.lit(0).cast("long"), True, True), (1, F.lit(1000).cast("long"), True, _n() % 3 == 1), (2, late.cast("long"), False, _n() % 5 != 0)]
    sent = _steps(spark, d, "step at asks taken", rows)
    kind = (_n() % len(EXCHANGES)).cast("int")
    pick = lambda values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), kind + 1)
    asks = F.col("asks")
    either = lambda a, b: F.when(asks, F.lit(a) if isinstance(a, str) else a).otherwise(F.lit(b) if isinstance(b, str) else b)
    dns = F.concat(txid, either("01000001000000000000", "81800001000000000000"), question)
    payloads = [
        dns, F.concat(txid, either("00000001000000000000", "80000001000000000000"), question),
        F.concat(txid, either("0110", "8500"), F.lit("0001000000000000" + "20" + "4845" * 16 + "00" + "00200001")),
        F.lit(None).cast("string"),
        F.concat(either("0001", "0101"), F.lit("00002112A442"), _hex(_n(), 12)),
        F.concat(either("23", "24"), F.lit("00" * 23), either("00" * 8, _hex(_n(), 8)), F.lit("00" * 8), either(_hex(_n(), 8), "00" * 8)),
        F.concat(either("C3", "E3"), F.lit("0000000108"), _hex(_n(), 8), F.lit("00" + "00" * 24)), F.lit(None).cast("string"),
    ]
    other = pick([e[5] for e in EXCHANGES])
    flags = kind == 7
    return sent.select(
        "page_id", pick([e[1] for e in EXCHANGES]).alias("protocol"), _ip(10).alias("local_ip"), pick([e[2] for e in EXCHANGES]).alias("local_port"), F.when(other, either("10.255.255.255", "10.255.255.9")).otherwise(_ip(5)).alias("remote_ip"), pick([e[3] for e in EXCHANGES]).alias("remote_port"),
        (asks == pick([e[4] for e in EXCHANGES])).alias("is_outgoing"), (_n() * 1_000_000 + F.col("at")).alias("us"), "frame_no", flags.alias("syn"), (flags & ~asks).alias("ack_flag"), F.when(kind == 3, either(F.lit(8), F.lit(0))).alias("icmp_type"), F.when(kind == 3, _n() % 65536).alias("icmp_id"), F.when(kind == 3, _n() % 100).alias("icmp_seq"),
        F.unhex(pick(payloads)).alias("payload"),
    )


def _latency(name: str, kind: str) -> None:
    at = [e[0] for e in EXCHANGES].index(kind)
    limit = "n % 7 <> 0"
    remotes = "['10.255.255.255', '10.255.255.9']" if EXCHANGES[at][5] else "[remote_ip]"
    sql = S + f" select local_ip, unnest({remotes}) as remote_ip, 3000 + n % 11 * 100 - case when n % 3 = 1 then 1000 else 0 end as latency_us from s where n % {len(EXCHANGES)} = {at} and n % 5 <> 0 and {limit}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = latency.measured(dpi.dissect(_exchanges(spark, d).where(_n() % len(EXCHANGES) == at)))
        return found.where(F.col("kind") == kind).select("local_ip", "remote_ip", "latency_us")

    query(name, sql)(run)


for _name, _kind in (("jn11_incoming_handshake", "handshake"), ("jn12_quic_packets", "quic"), ("jn13_dns_messages", "dns"), ("jn14_llmnr_both_flows", "llmnr"), ("jn15_netbios_both_flows", "netbios"), ("jn16_echo_numbers", "icmp"), ("jn17_stun_ids", "stun"), ("jn18_ntp_echoed_times", "ntp")):
    _latency(_name, _kind)


# -- merges by protocol ------------------------------------------------------------


def _flow(sent: DataFrame, protocol: str, port: Column) -> DataFrame:
    given = sent.select("page_id", F.lit(protocol).alias("protocol"), _ip(10).alias("local_ip"), F.lit(40000).alias("local_port"), _ip(5).alias("remote_ip"), port.cast("int").alias("remote_port"), (F.col("step") % 2 == 0).alias("is_outgoing"), (_n() * 1_000_000 + F.col("step")).alias("us"), "frame_no", F.unhex("data").alias("payload"))
    return given.withColumn("packet_len", F.length("payload").cast("long"))


def _merged(spark: SparkSession, d: str, protocol: str, port: Column, *payloads: tuple[Column, Column | bool]) -> DataFrame:
    rows = [(k, data, taken) for k, (data, taken) in enumerate(payloads)]
    return dpi.connections(dpi.dissect(_flow(_steps(spark, d, "step data taken", rows), protocol, port))).select("local_ip", "packets", "dpi.*")


@query("fl13_ssh_states", S + """ select local_ip, 'SSH' as app, '2.0' as version, 'cli' || n as software, ['Banner', 'KeyExchange', 'Authentication', 'Established'][n % 4 + 1] as kind,
case when n % 8 = 7 then ['aes256-ctr'] when n % 4 = 0 then [] when n % 4 = 1 then ['aes128-ctr', 'ssh-rsa'] else ['aes128-ctr', 'ssh-rsa', 'hmac-sha2-256'] end as algorithms, n % 4 + 2 as packets from s""")
def fl13_ssh(spark: SparkSession, d: str) -> DataFrame:
    """Off port 22; the key exchange names algorithms again, an authentication one more, every second success its own. A last packet shows an earlier state."""
    banner, kex = _text(F.concat(F.lit("SSH-2.0-cli"), _n().cast("string"), F.lit("\r\n"))), F.concat(F.lit("000001000814"), _text(F.lit("ssh-rsa,aes128-ctr,ssh-rsa")))
    auth, done = F.concat(F.lit("000000400632"), _text(F.lit("hmac-sha2-256"))), F.concat(F.lit("000000200A34"), F.when(_n() % 8 == 7, _text(F.lit("aes256-ctr"))).otherwise("00"))
    far = _n() % 4
    rows = _merged(spark, d, "TCP", F.lit(2222), (banner, True), (kex, far > 0), (auth, far > 1), (done, far > 2), (_text(F.lit("SSH-2.0-other\r\n")), True))
    return rows.select("local_ip", "app", "version", "software", "kind", "algorithms", F.col("packets").cast("int"))


@query("fl12_address_union", S + """ select local_ip, 'DNS' as app, host as query, ['203.0.113.' || n % 256, '203.0.113.' || (n + 1) % 256] as ips, true as is_response, cast((n + 3) % 65536 as varchar) as txid, case when n % 2 = 0 then 3 else 0 end as code from s""")
def fl12_union(spark: SparkSession, d: str) -> DataFrame:
    """A query, three answers of two addresses, a refusal for every second page, and a query of another name."""
    named = lambda label: F.concat(_hex(F.length(label), 1), _text(label), F.lit("076578616D706C6503636F6D00" + "00010001"))
    head = lambda k, flags: F.concat(_hex((_n() + k) % 65536, 2), F.lit(flags))
    answer = lambda k, ip: F.concat(head(k, "81800001000100000000"), named(_label(_n())), F.lit("C00C000100010000003C0004CB0071"), _hex(ip % 256, 1))
    ask, other = F.concat(head(0, "01000001000000000000"), named(_label(_n()))), F.concat(head(3, "01000001000000000000"), named(F.concat(F.lit("x"), _label(_n()))))
    refused = F.concat(head(2, "81830001000000000000"), named(_label(_n())))
    rows = _merged(spark, d, "UDP", F.lit(53), (ask, True), (answer(0, _n()), True), (answer(1, _n() + 1), True), (answer(1, _n()), True), (refused, _n() % 2 == 0), (other, True))
    return rows.select("local_ip", "app", "query", "ips", "is_response", "txid", "code")


@query("fl9_kept_fields", S + """ select local_ip, case n % 3 when 0 then 'HTTP' when 1 then 'FTP' else 'MQTT' end as app, case when n % 3 = 0 then 'GET' end as method, case when n % 3 = 0 then '/a' || n end as path, case n % 3 when 0 then 200 when 1 then 331 end as code,
case when n % 3 = 1 then 'PASS' end as command, case n % 3 when 1 then 'u' || n end as username, case when n % 3 = 2 then 'PUBLISH' end as kind, case when n % 3 = 2 then 't/1' end as topic, case when n % 3 = 2 then 'm' || n end as client_id from s""")
def fl9_kept(spark: SparkSession, d: str) -> DataFrame:
    """HTTP keeps its first request and status, FTP its user and the last command and reply, MQTT its client and topic and the last kind; a payload of another protocol changes nothing."""
    tail, kind = _n().cast("string"), _n() % 3
    client = F.concat(F.lit("m"), tail)
    three = lambda a, b, c: F.when(kind == 0, _text(a)).when(kind == 1, _text(b)).otherwise(c)
    publish = lambda t: F.concat(F.lit("300700032F"), F.lit(t))
    connect = F.concat(F.lit("10"), _hex(F.length(client) + 12, 1), F.lit("00044D5154540402003C"), _hex(F.length(client), 2), _text(client))
    steps = [
        three(F.concat(F.lit("GET /a"), tail, F.lit(" HTTP/1.1\r\n\r\n")), F.concat(F.lit("USER u"), tail, F.lit("\r\n")), connect),
        three(F.lit("HTTP/1.1 200 OK\r\n\r\n"), F.lit("331 Password\r\n"), F.lit("30070003" + "742F31" + "6869")),
        three(F.lit("POST /b HTTP/1.1\r\n\r\n"), F.lit("PASS x\r\n"), F.lit("30070003" + "742F32" + "6869")),
        three(F.lit("HTTP/1.1 404 No\r\n\r\n"), F.lit("GET /c HTTP/1.1\r\n\r\n"), _text(F.lit("GET /c HTTP/1.1\r\n\r\n"))),
    ]
    rows = _merged(spark, d, "TCP", F.when(kind == 0, 80).when(kind == 1, 21).otherwise(1883), *((s, True) for s in steps))
    return rows.select("local_ip", "app", "method", "path", "code", "command", "username", "kind", "topic", "client_id")


@query("fl9_first_packet_stays", S + """ select local_ip, 'NTP' as app, '4' as version, 'Client' as kind, lpad(lower(to_hex(n)), 16, '0') as transmit from s""")
def fl9_first(spark: SparkSession, d: str) -> DataFrame:
    sent = lambda first, at: F.concat(F.lit(first + "00" * 39), at)
    rows = _merged(spark, d, "UDP", F.lit(123), (sent("23", _hex(_n(), 8)), True), (sent("1C", _hex(_n() + 1, 8)), True))
    return rows.select("local_ip", "app", "version", "kind", "transmit")


@query("dp15_stun_software", S + """ select local_ip, 'STUN' as app, case when n % 3 <> 2 then 'h' || n end as software from s""")
def dp15_software(spark: SparkSession, d: str) -> DataFrame:
    """The software behind another attribute that is padded; an attribute before it that runs over the end hides it."""
    size = F.length(_label(_n()))
    body = F.concat(F.when(_n() % 3 == 2, "00060FFF").otherwise("00060003"), F.lit("61626300" + "8022"), _hex(size, 2), _text(_label(_n())), F.repeat(F.lit("00"), ((4 - size % 4) % 4).cast("int")))
    rows = _merged(spark, d, "UDP", F.lit(3478), (F.concat(F.lit("0001"), _hex(F.length(body) / 2, 2), F.lit("2112A442"), _hex(_n(), 12), body), True))
    return rows.select("local_ip", "app", "software")
