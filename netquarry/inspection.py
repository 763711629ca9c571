"""Registered queries of frame ingest and application inspection, on payloads made from the pages table, each with SQL for its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.catalog import FLOWS_SQL, KEYS, SOCKETS_SQL, P, _frames, _local_hosts, _processes, _sockets, _unhosted, flows, query
from netquarry.functions import net
from netquarry.operators import aggregates, capture, dpi, filters, joins, latency, quic, sorts
from netquarry.plans.packets import FLOW, packets, table

KINDS = ["HTTP", "HTTPS", "DNS query", "DNS answer", "SSH", "FTP", "NTP", "SSDP", "DHCP", "STUN", "MQTT", "none", "SNMP", "NetBIOS", "DHT", "uTP", "QUIC", "SMTP", "POP3", "mDNS", "MQTT connect"]
PORTS = [80, 443, 53, 53, 22, 21, 123, 1900, 67, 3478, 1883, 9999, 161, 137, 6881, 6882, 443, 2525, 110, 5353, 1999]
TCP_KINDS = ["HTTP", "HTTPS", "SSH", "FTP", "MQTT", "SMTP", "POP3", "MQTT connect"]


def _hex(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def _text(s: Column) -> Column:
    return F.hex(F.encode(s, "utf-8"))


def _label(n: Column) -> Column:
    return F.concat(F.lit("h"), n.cast("string"))


def _hello(host: Column) -> Column:
    """A ClientHello as hex: server name, ALPN h2."""
    size = F.length(host)
    return F.concat(
        F.lit("01"), _hex(size + 61, 3), F.lit("0303" + "00" * 32 + "00" + "00021301" + "0100"), _hex(size + 18, 2),
        F.lit("0000"), _hex(size + 5, 2), _hex(size + 3, 2), F.lit("00"), _hex(size, 2), _text(host), F.lit("001000050003026832"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One payload a page, of the kinds in turn, as a packet of its own flow."""
    n = F.col("page_id")
    tail = n.cast("string")
    label = _label(n)
    host = F.concat(label, F.lit(".example.com"))
    name = F.concat(_hex(F.length(label), 1), _text(label), F.lit("076578616D706C6503636F6D00"))
    size = F.length(host)
    question = F.concat(name, F.lit("00010001"))
    hello = F.concat(F.lit("160301"), _hex(size + 65, 2), _hello(host))
    netbios = F.translate(F.concat(F.hex(F.encode(F.rpad(F.concat(F.lit("H"), tail), 15, " "), "utf-8")), F.lit("00")), "0123456789ABCDEF", "ABCDEFGHIJKLMNOP")
    community, client = F.concat(F.lit("c"), tail), F.concat(F.lit("m"), tail)
    topic = F.concat(F.lit("t/"), tail)
    payloads = [
        _text(F.concat(F.lit("GET /p"), tail, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\nUser-Agent: ua/1\r\n\r\n"))),
        hello,
        F.concat(_hex(n % 65536, 2), F.lit("01000001000000000000"), question),
        F.concat(_hex(n % 65536, 2), F.lit("81800001000100000000"), question, F.lit("C00C000100010000003C0004CB0071"), _hex(n % 256, 1)),
        _text(F.concat(F.lit("SSH-2.0-OpenSSH_9."), (n % 10).cast("string"), F.lit("\r\n"))),
        _text(F.concat(F.lit("220 ProFTPD"), tail, F.lit(" ready\r\n"))),
        F.concat(F.lit("23"), _hex(n % 16, 1), F.lit("00" * 22), _hex(n, 8), F.lit("00" * 16)),
        _text(F.concat(F.lit("M-SEARCH * HTTP/1.1\r\nST: urn:x"), tail, F.lit("\r\n\r\n"))),
        F.concat(F.lit("01" + "00" * 27), _hex(n, 6), F.lit("00" * 202 + "63825363" + "350103" + "0C"), _hex(F.length(label), 1), _text(label), F.lit("FF")),
        F.concat(F.lit("000100002112A442"), _hex(n, 12)),
        F.concat(F.lit("30"), _hex(F.length(topic) + 4, 1), _hex(F.length(topic), 2), _text(topic), F.lit("6869")),
        F.lit("0102"),
        F.concat(F.lit("30"), _hex(F.length(community) + 10, 1), F.lit("02010104"), _hex(F.length(community), 1), _text(community), F.lit("A003020101")),
        F.concat(_hex(n % 65536, 2), F.lit("01100001000000000000" + "20"), _text(netbios), F.lit("0000200001")),
        _text(F.concat(F.lit("d1:ad2:id20:"), F.lpad(tail, 20, "x"), F.lit("e1:q4:ping1:t2:aa1:y1:qe"))),
        F.concat(F.lit("4100"), _hex(n % 65535 + 1, 2), F.lit("00" * 8 + "00100000" + "00010000")),
        F.lit(None),  # made below: it is encrypted
        _text(F.concat(F.lit("220 mail"), tail, F.lit(" ESMTP\r\n"))),
        _text(F.concat(F.lit("USER u"), tail, F.lit("\r\n"))),
        F.concat(F.lit("000084000001000000010001"), question, F.lit("C00C000200010000003C0002C00C" + "C00C000100010000003C0004CB0071"), _hex(n % 256, 1)),
        F.concat(F.lit("10"), _hex(F.length(client) + 12, 1), F.lit("00044D5154540402003C"), _hex(F.length(client), 2), _text(client)),
    ]
    kind = (n % len(KINDS)).cast("int")
    pick = lambda values: F.element_at(F.array(*values), kind + 1)
    rows = table(spark, d, "pages").where(n.isNotNull()).select("page_id", pick([F.lit(k) for k in KINDS]).alias("kind"), pick([F.lit(p) for p in PORTS]).alias("remote_port"), pick([F.lit(k in TCP_KINDS) for k in KINDS]).alias("tcp"), F.unhex(pick(payloads)).alias("__given"), host.alias("__host"))
    sealed = quic.protected(rows, F.when(F.col("kind") == "QUIC", _crypto(_hello(F.col("__host")), F.lit(0))), F.unhex(_hex(n, 8)), 1, F.lit(0))
    return sealed.withColumn("payload", F.coalesce("payload", "__given")).select(
        "page_id", "kind", F.when(F.col("tcp"), "TCP").otherwise("UDP").alias("protocol"), F.lit("10.0.0.1").alias("local_ip"), (F.lit(40000) + n % 20000).cast("int").alias("local_port"),
        F.concat(F.lit("203.0.113."), (n % 250).cast("string")).alias("remote_ip"), "remote_port", F.lit(True).alias("is_outgoing"), F.length("payload").cast("long").alias("packet_len"), n.alias("frame_no"), (n * 1000).alias("us"), "payload",
    )


def _crypto(data: Column, at: Column) -> Column:
    """A CRYPTO frame of hex data and its padding, as bytes."""
    return F.unhex(F.concat(F.lit("06"), _hex(at + 0x4000, 2), _hex(F.length(data) / 2 + 0x4000, 2), data, F.lit("00" * 24)))


def _quic(spark: SparkSession, d: str, migrating: bool = False, closing: bool = False) -> DataFrame:
    """Three datagrams a page, each with a third of a ClientHello, the last part first; the second from another port if `migrating`; every fourth page's connection is closed if `closing`."""
    n = F.col("page_id")
    pages = table(spark, d, "pages").where(n.isNotNull()).select("page_id", _hello(F.concat(_label(n), F.lit(".example.com"))).alias("h"))
    parts = pages.select("page_id", "h", F.explode(F.array(*map(F.lit, range(4 if closing else 3)))).alias("k")).where((F.col("k") < 3) | (n % 4 == 0))
    size = F.floor(F.length("h") / 6) * 2
    data = F.expr("substring(h, cast(k * floor(length(h) / 6) * 2 as int) + 1, cast(if(k = 2, length(h), floor(length(h) / 6) * 2) as int))")
    plain = F.when(F.col("k") == 3, F.unhex(F.lit("1C000000" + "00" * 30))).otherwise(_crypto(data, F.col("k") * size / 2))
    sealed = quic.protected(parts, plain, F.unhex(_hex(n, 8)), 1, F.col("k"))
    port = F.lit(40000) + F.when((F.col("k") == 1) & F.lit(migrating), 1).otherwise(0)
    late = F.when(F.col("k") == 3, 3).otherwise((F.col("k") + 1) % 3)
    return sealed.select(F.lit("UDP").alias("protocol"), F.concat_ws(".", F.lit("10"), *((F.floor(n / 250**e) % 250).cast("string") for e in (2, 1, 0))).alias("local_ip"), port.cast("int").alias("local_port"), F.lit("203.0.113.9").alias("remote_ip"), F.lit(443).alias("remote_port"), (n * 10 + late).alias("us"), (n * 10 + late).alias("frame_no"), "payload", "page_id")


_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + f"][page_id % {len(KINDS)} + 1]"
M = f"with m as (select page_id, {_KIND_SQL} as kind, 'h' || page_id || '.example.com' as host from pages where page_id is not null)"
_SHOWN = """case kind when 'HTTP' then 'HTTP (' || host || ')' when 'HTTPS' then 'HTTPS (' || host || ')' when 'DNS query' then 'DNS (' || host || ')' when 'DNS answer' then 'DNS (' || host || ')' when 'SSH' then 'SSH (OpenSSH)'
  when 'FTP' then 'FTP 220 (ProFTPD' || page_id || ')' when 'NTP' then 'NTP (v4 Client)' when 'SSDP' then 'SSDP M-SEARCH (urn:x' || page_id || ')' when 'DHCP' then 'DHCP REQUEST (h' || page_id || ')' when 'STUN' then 'STUN Binding Request' when 'MQTT' then 'MQTT PUBLISH (t/' || page_id || ')'
  when 'SNMP' then 'SNMP v2c GET (c' || page_id || ')' when 'NetBIOS' then 'NetBIOS NS (H' || page_id || ')' when 'DHT' then 'BT DHT (ping)' when 'uTP' then 'BT uTP' when 'QUIC' then 'QUIC' when 'mDNS' then 'mDNS (' || host || ')' when 'MQTT connect' then 'MQTT CONNECT (m' || page_id || ')' end"""


def _inspected(spark: SparkSession, d: str) -> DataFrame:
    return dpi.dissect(messages(spark, d))


@query("sf8_applications", M + f" select page_id, {_SHOWN} as application, case when kind in ('HTTP', 'HTTPS') then host end as hostname from m")
def sf8(spark: SparkSession, d: str) -> DataFrame:
    return _inspected(spark, d).select("page_id", dpi.display(F.col("dpi")).alias("application"), dpi.hostname(F.col("dpi")).alias("hostname"))


@query("sf10_dpi_domain", M + " select page_id, case when kind in ('HTTP', 'HTTPS', 'DNS query', 'DNS answer') then host end as dpi_domain from m")
def sf10(spark: SparkSession, d: str) -> DataFrame:
    return _inspected(spark, d).select("page_id", dpi.domain(F.col("dpi")).alias("dpi_domain"))


@query("sf2_udp_states", M + " select page_id, case kind when 'DNS query' then 'DNS_QUERY' when 'DNS answer' then 'DNS_RESPONSE' when 'NTP' then 'NTP' when 'SSDP' then 'SSDP_M-SEARCH' when 'DHCP' then 'DHCP_REQUEST' when 'STUN' then 'STUN_Request' when 'SNMP' then 'SNMP_GET' when 'NetBIOS' then 'NETBIOS_NS' when 'DHT' then 'BT_UDP' when 'uTP' then 'BT_UDP' when 'QUIC' then 'QUIC_INITIAL' when 'mDNS' then 'MDNS_RESPONSE' when 'none' then case when page_id % 100 > 60 then 'UDP_STALE' when page_id % 100 > 30 then 'UDP_IDLE' else 'UDP_ACTIVE' end else 'ESTABLISHED' end as state from m")
def sf2_udp(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    shown = dpi.state(F.col("protocol"), F.lit("ESTABLISHED"), F.col("dpi"), F.col("page_id") % 100, none, none, none, none, none, none, none, none)
    return _inspected(spark, d).select("page_id", shown.alias("state"))


@query("sf2_other_states", """select p_partkey, case p_partkey % 3 when 0 then case p_partkey % 5 when 0 then 'ECHO_REQ(' || (p_partkey % 1000) || ')' when 1 then 'ECHO_REPLY' when 2 then 'DEST_UNREACH' when 3 then 'TIME_EXCEEDED' else 'ICMP_OTHER' end
  when 1 then case p_partkey % 4 when 0 then 'QUERY(224.0.0.1)' when 1 then 'REPORT_V3' when 2 then 'LEAVE_GROUP(224.0.0.1)' else 'IGMP_OTHER' end
  else case when p_partkey % 2 = 0 then 'ARP_WHO_HAS 10.0.0.9' else 'ARP_IS_AT 02:00:00:00:00:01' || case when p_partkey % 5 = 0 then ' (Acme)' else '' end end end as state from part""")
def sf2_other(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    at = lambda n, *values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (k % n + 1).cast("int"))
    parts = {
        "protocol": at(3, "ICMP", "IGMP", "ARP"), "icmp_type": at(5, 8, 0, 3, 11, 5), "icmp_id": F.when(k % 5 == 0, k % 1000), "igmp_type": at(4, 0x11, 0x22, 0x17, 0x99), "igmp_group": F.when(k % 4 % 2 == 0, "224.0.0.1"),
        "op": at(2, "request", "reply"), "vendor": F.when((k % 2 == 1) & (k % 5 == 0), "Acme"),
    }
    app = F.lit(None).cast("struct<app:string,kind:string,is_response:boolean>")
    shown = dpi.state(parts["protocol"], F.lit(None), app, F.lit(0), parts["icmp_type"], parts["icmp_id"], parts["igmp_type"], parts["igmp_group"], parts["op"], F.lit("10.0.0.9"), F.lit("02:00:00:00:00:01"), parts["vendor"])
    return table(spark, d, "part").select("p_partkey", shown.alias("state"))


def _fields(name: str, kinds: str, sql: str, *fields: str) -> None:
    """Register the fields that one protocol's dissector finds in its own messages."""
    wanted = [k for k in KINDS if k in kinds.split(",")]
    listed = ", ".join(f"'{k}'" for k in wanted)
    query(name, M + f" select page_id, {sql} from m where kind in ({listed})")(lambda s, d: _inspected(s, d).where(F.col("kind").isin(wanted)).select("page_id", *(F.col(f"dpi.{f}") for f in fields)))


_fields("dp2_tls", "HTTPS", "'HTTPS' as app, host as sni, ['h2'] as alpn, 'ClientHello' as kind", "app", "sni", "alpn", "kind")
_fields("dp6_dns", "DNS query,DNS answer", "'DNS' as app, host as query, kind = 'DNS answer' as is_response, case when kind = 'DNS answer' then ['203.0.113.' || (page_id % 256)] else [] end as ips, cast(page_id % 65536 as varchar) as txid", "app", "query", "is_response", "ips", "txid")
_fields("dp11_ssh", "SSH", "'SSH' as app, '2.0' as version, 'OpenSSH_9.' || (page_id % 10) as software", "app", "version", "software")
_fields("dp12_ftp", "FTP", "'FTP' as app, 220 as code, 'ProFTPD' || page_id as software", "app", "code", "software")
_fields("dp16_ntp", "NTP", "'NTP' as app, '4' as version, 'Client' as kind, lpad(lower(to_hex(page_id)), 16, '0') as txid", "app", "version", "kind", "txid")
_fields("dp15_stun", "STUN", "'STUN' as app, 'Request' as kind, 1 as code, lpad(lower(to_hex(page_id)), 24, '0') as txid", "app", "kind", "code", "txid")
_fields("dp13_mqtt", "MQTT", "'MQTT' as app, 'PUBLISH' as kind, 't/' || page_id as topic", "app", "kind", "topic")
_fields("dp17_dhcp", "DHCP", "'DHCP' as app, 'REQUEST' as kind, 'h' || page_id as hostname", "app", "kind", "hostname")
_fields("dp13_mqtt_off_port", "MQTT connect,SMTP,POP3", "case when kind = 'MQTT connect' then 'MQTT' end as app, case when kind = 'MQTT connect' then 'CONNECT' end as kind, case when kind = 'MQTT connect' then 'm' || page_id end as client_id", "app", "kind", "client_id")
_fields("dp7_mdns", "mDNS", "'mDNS' as app, host as query, true as is_response, ['203.0.113.' || (page_id % 256)] as ips", "app", "query", "is_response", "ips")
_fields("dp8_quic", "QUIC", "'QUIC' as app, 'Initial' as kind, 'v1' as version, lpad(lower(to_hex(page_id)), 16, '0') as txid", "app", "kind", "version", "txid")
_fields("dp14_bittorrent_udp", "DHT,uTP", "'BitTorrent' as app, kind, case when kind = 'DHT' then 'ping' end as method", "app", "kind", "method")
_fields("dp18_snmp", "SNMP", "'SNMP' as app, 'v2c' as version, 'GET' as kind, 'c' || page_id as community", "app", "version", "kind", "community")
_fields("dp20_netbios", "NetBIOS", "'NetBIOS' as app, 'NS' as kind, 'Query' as command, 'H' || page_id as hostname, false as is_response, cast(page_id % 65536 as varchar) as txid", "app", "kind", "command", "hostname", "is_response", "txid")
_fields("dp19_ssdp", "SSDP", "'SSDP' as app, 'M-SEARCH' as kind, 'urn:x' || page_id as target", "app", "kind", "target")

_CONNECTED = f""", c as (select 10000 as any_, case when kind in ({", ".join(f"'{k}'" for k in TCP_KINDS)}) then 'TCP' else 'UDP' end as protocol, 40000 + page_id % 20000 as local_port, '203.0.113.' || (page_id % 250) as remote_ip, {PORTS}[page_id % {len(KINDS)} + 1] as remote_port, * from m),
f as (select protocol, cast(local_port as integer) as local_port, remote_ip, remote_port, count(*) as packets, arg_min(kind, page_id) filter (kind not in ('none', 'SMTP', 'POP3')) as kind, arg_min(host, page_id) filter (kind in ('HTTP', 'HTTPS')) as name from c group by 1, 2, 3, 4)"""


@query("fl1_inspected_flows", M + _CONNECTED + " select protocol, local_port, remote_ip, remote_port, packets, case when kind in ('DHT', 'uTP') then 'BitTorrent' else split_part(kind, ' ', 1) end as app, name from f")
def fl1(spark: SparkSession, d: str) -> DataFrame:
    rows = dpi.connections(_inspected(spark, d))
    return rows.select("protocol", "local_port", "remote_ip", "remote_port", "packets", F.col("dpi.app").alias("app"), dpi.hostname(F.col("dpi")).alias("name"))


_PAGES = "select page_id, 'h' || page_id || '.example.com' as host, '10.' || (page_id // 62500) % 250 || '.' || (page_id // 250) % 250 || '.' || page_id % 250 as local_ip from pages where page_id is not null"


@query("dp9_quic_sni", f"select local_ip, 40000 as local_port, host as sni, ['h2'] as alpn, 'v1' as version, 3 as quic_packets from ({_PAGES})")
def dp9(spark: SparkSession, d: str) -> DataFrame:
    return quic.flows(_quic(spark, d)).select("local_ip", "local_port", "sni", "alpn", "version", F.col("quic_packets").cast("int"))


@query("fl2_quic_migration", f"select local_ip, 40000 as local_port, host as sni, 3 as quic_packets from ({_PAGES})")
def fl2_quic(spark: SparkSession, d: str) -> DataFrame:
    return quic.flows(_quic(spark, d, migrating=True)).select("local_ip", "local_port", "sni", F.col("quic_packets").cast("int"))


@query("fl11_quic_states", f"select local_ip, case when page_id % 4 = 0 then 'Draining' else 'Initial' end as state, 'QUIC (' || host || ')' as application, case when page_id % 4 = 0 then 'QUIC_DRAINING' else 'QUIC_INITIAL' end as shown from ({_PAGES})")
def fl11(spark: SparkSession, d: str) -> DataFrame:
    packets_ = _quic(spark, d, closing=True).withColumns({"is_outgoing": F.lit(True), "packet_len": F.length("payload").cast("long")})
    rows = dpi.with_quic(dpi.connections(dpi.dissect(packets_)), packets_)
    none, app = F.lit(None), F.col("dpi")
    return rows.select("local_ip", app["kind"].alias("state"), dpi.display(app).alias("application"), dpi.state(F.col("protocol"), none, app, F.lit(0), none, none, none, none, none, none, none, none).alias("shown"))


@query("fl1_ingest", P + f" select {KEYS}, cast(sum(case when is_outgoing then case when protocol = 'TCP' then 54 else 46 end else 0 end) as bigint) as bytes_sent, cast(sum(case when is_outgoing then 0 when protocol = 'TCP' then 54 else 46 end) as bigint) as bytes_received, count(*) as packets, min(us) as created_us, max(us) as last_us from packets where protocol <> 'ICMP' group by all")
def fl1_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = _unhosted(dpi.ingest(_frames(spark, d), _local_hosts(spark, d)))
    return rows.select(*FLOW, F.col("bytes_sent"), "bytes_received", "packets", "created_us", "last_us")


def _searched(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = dpi.searchable(_inspected(spark, d))
        return rows.where(filters.parse(text, rows.columns)).select("page_id")

    query(name, M + f" select page_id from m where {sql}")(run)


_searched("fi13_software", "openssh_9.4", "kind = 'SSH' and page_id % 10 = 4")
_searched("fi13_topic", "t/1", "kind = 'MQTT' and page_id::varchar like '1%'")
_searched("fi13_host", "/^h1.*example/", "kind in ('HTTP', 'HTTPS', 'DNS query', 'DNS answer', 'mDNS') and page_id::varchar like '1%'")
_searched("fi13_command", "m-search", "kind = 'SSDP'")
_searched("fi13_and", "app:http sni:h2", "kind in ('HTTPS', 'HTTP') and page_id::varchar like '2%'")


# -- lookups over these ----------------------------------------------------------


@query("jn3_neighbour_of_flow", P + """, l as (select us, frame_no, local_ip as ip, '02:00:00:00:00:' || lpad(to_hex(txid % 16), 2, '0') as mac from packets union all select us, frame_no, remote_ip, '02:00:00:00:01:' || lpad(to_hex(txid % 16), 2, '0') from packets where not is_outgoing),
n as (select ip, lower(max_by(mac, frame_no)) as mac from l group by ip)""" + f" select distinct {KEYS}, n.mac as remote_mac from packets p left join n on n.ip = p.remote_ip")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    mac = lambda n: F.lower(F.concat(F.lit(f"02:00:00:00:{n}:"), F.lpad(F.hex(F.col("txid") % 16), 2, "0")))
    p = packets(spark, d)
    arp = p.select("us", "frame_no", F.when(F.col("is_outgoing"), "request").otherwise("reply").alias("op"), F.col("local_ip").alias("sender_ip"), mac("00").alias("sender_mac"), F.col("remote_ip").alias("target_ip"), mac("01").alias("target_mac"))
    return joins.with_neighbour(p.select(*FLOW).distinct(), aggregates.neighbours(arp)).select(*FLOW, "remote_mac")


@query("jn24_kernel_owner", SOCKETS_SQL + f""", k as (select distinct {KEYS}, user_id + 5000 as pid from packets where user_id % 5 = 0),
o as (select b.user_id, s.pid, case when s.remote_port <> 0 then 1 when s.local_ip <> '0.0.0.0' then 2 else 3 end as rank from base b join s on s.protocol = b.protocol and s.local_port = b.local_port and b.protocol in ('TCP', 'UDP')
and ((s.local_ip = '0.0.0.0' and s.remote_ip = b.remote_ip and s.remote_port = b.remote_port) or (s.local_ip = b.local_ip and s.remote_ip = '0.0.0.0' and s.remote_port = 0) or (s.local_ip = '0.0.0.0' and s.remote_ip = '0.0.0.0' and s.remote_port = 0))),
r as (select user_id, min(pid) as pid from o group by 1 having count(distinct pid) = 1)
select b.user_id, coalesce(case when b.user_id % 5 = 0 then b.user_id + 5000 end, r.pid) as pid, case when b.user_id % 5 = 0 then 'exact-tuple' when r.pid is not null then 'procfs-relaxed' else 'unspecified' end as quality from base b left join r using (user_id)""")
def jn24(spark: SparkSession, d: str) -> DataFrame:
    rows = packets(spark, d).select(*FLOW, "user_id").distinct()
    kernel = rows.where("user_id % 5 = 0").select(*FLOW, (F.col("user_id") + 5000).alias("pid"), F.lit("k").alias("name"))
    return joins.kernel_owner(rows, kernel, _sockets(spark, d), ["user_id"]).select("user_id", "pid", "quality")


@query("sk8_notes_of_generation", FLOWS_SQL + f" select {KEYS}, case when last_txid % 2 = 0 then 'note' end as note from flows")
def sk8(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    stale = F.when(F.col("last_txid") % 2 == 0, F.col("created_us")).otherwise(F.col("created_us") - 1)
    notes = rows.select(*FLOW, stale.alias("created_us"), F.lit("note").alias("note"))
    return joins.of_generation(rows.select(*FLOW, "created_us"), notes, FLOW).select(*FLOW, "note")


@query("so6_visible_processes", FLOWS_SQL + " select process_name, cast(sum(bytes_sent) as bigint) as tx from flows group by 1 order by tx desc, process_name nulls first limit 10")
def so6(spark: SparkSession, d: str) -> DataFrame:
    g = flows(spark, d).groupBy("process_name").agg(F.sum("bytes_sent").alias("tx")).withColumn("pid", F.lit(None).cast("long"))
    return sorts.visible_processes(g, "tx").select("process_name", "tx")


@query("sf27_process_tree", """with p as (select c_custkey as pid, c_custkey // 3 as ppid, c_name as name from customer)
select a.pid, case when c.pid is not null and c.pid <> b.pid and b.pid <> a.pid and c.pid <> a.pid then '… ' else '' end as deep, coalesce(b.name || ' (' || b.pid || ') → ', '') || a.name || ' (' || a.pid || ')' as tree, case when a.pid % 2 = 0 then a.name || ' (' || a.pid || ')' else cast(a.pid as varchar) end as owner
from p a left join p b on b.pid = a.ppid and b.pid <> a.pid left join p c on c.pid = b.ppid""")
def sf27(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.lineage(_processes(spark, d), levels=1)
    owner = net.owner_label(F.when(F.col("pid") % 2 == 0, F.col("name")), F.col("pid"))
    return rows.select("pid", F.when(F.col("truncated"), "… ").otherwise("").alias("deep"), net.process_tree(F.col("ancestors"), F.col("name"), F.col("pid")).alias("tree"), owner.alias("owner"))


@query("sf28_link_classes", "select p_partkey, case p_partkey % 4 when 0 then 'Tun' when 1 then 'Tap' else case p_partkey % 7 when 0 then 'Ethernet' when 1 then 'RawIP' when 2 then 'LinuxSLL' when 3 then 'LinuxSLL2' when 4 then 'Pktap' when 5 then 'RawIP' else 'Unknown' end end as class from part")
def sf28(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    link = F.element_at(F.array(*map(F.lit, [1, 101, 113, 276, 258, 0, 999])), (k % 7 + 1).cast("int"))
    interface = F.element_at(F.array(*map(F.lit, ["utun0", "tap1", "eth0", "lo"])), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", net.link_class(link, interface).alias("class"))


@query("pr16_address_kinds", P + " select distinct remote_ip, case when cast(split_part(remote_ip, '.', 4) as integer) = 7 then 'Broadcast' else 'Unicast' end as kind from packets")
def pr16(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("203.0.113.7",)], "ip string")
    rows = joins.flagged(packets(spark, d).select("remote_ip").distinct(), "remote_ip", known, "ip", "subnet_broadcast")
    return rows.select("remote_ip", net.address_kind(F.col("remote_ip"), F.col("subnet_broadcast")).alias("kind"))


@query("jn6_geoip6", """with a as (select s_suppkey as k, s_suppkey % 25 as n, s_suppkey % 7 as m, s_suppkey % 11 = 0 as private, s_suppkey % 5 = 0 as four from supplier),
g as (select a.*, case when private or (four and n = 0) then null when four and n % 2 = 1 then 'World' when not four and n % 4 = 0 and m = 3 then n_name || '-3' when n % 2 = 0 then n_name when not four then 'Town' end as country from a join nation on n_nationkey = n)
select k, country, case when country is null then null when country = 'World' then 'W' when country = 'Town' then 'T' else 'C' end as country_code, case when private then null when four and n = 0 then null else n * 10 + m // 2 end as asn, case when not private and not four and n % 2 = 1 then 'c' || n end as city, not private and not (four and n = 0) as has_data from g""")
def jn6_geoip6(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    h = lambda c: F.lower(F.hex(c.cast("long")))
    text = lambda c: c.cast("string")
    six, four = F.concat(F.lit("2a00:"), h(k % 25 + 16), F.lit(":"), h(k % 7), F.lit("::"), h(k)), F.concat_ws(".", F.lit("5"), text(k % 25), text(k % 7), text(k % 250))
    rows = table(spark, d, "supplier").select(k.alias("k"), F.when(k % 11 == 0, F.when(k % 5 == 0, "192.168.7.9").otherwise(F.concat(F.lit("fd00::"), h(k)))).when(k % 5 == 0, four).otherwise(six).alias("ip"))
    nations = table(spark, d, "nation").select(n, "n_name")
    block = lambda rows_, cidr, **values: rows_.select(cidr.alias("cidr"), *(v.alias(c) for c, v in values.items()))
    wide, narrow = F.concat(F.lit("2a00:"), h(n + 16), F.lit("::/32")), F.concat(F.lit("2a00:"), h(n + 16), F.lit(":3::/48"))
    named = lambda name: {"country_code": F.lit("C"), "country_name": name}
    even = nations.where(n % 2 == 0)
    countries = block(even, wide, **named(F.col("n_name"))).unionByName(block(even.where(n > 0), F.concat(F.lit("5."), text(n), F.lit(".0.0/16")), **named(F.col("n_name")))).unionByName(block(even.where(n % 4 == 0), narrow, **named(F.concat("n_name", F.lit("-3")))))
    countries = countries.unionByName(block(nations.where(n % 2 == 1), F.concat(F.lit("5."), text(n), F.lit(".0.0/17")), country_code=F.lit("W"), country_name=F.lit("World")))
    pairs = nations.select(n, F.explode(F.array(*map(F.lit, (0, 2, 4, 6)))).alias("m"))
    m = F.col("m")
    systems = block(pairs, F.concat(F.lit("2a00:"), h(n + 16), F.lit(":"), h(m), F.lit("::/47")), asn=n * 10 + F.expr("m div 2"), as_org=F.lit("o")).unionByName(block(pairs.where(n > 0), F.concat(F.lit("5."), text(n), F.lit("."), text(m), F.lit(".0/23")), asn=n * 10 + F.expr("m div 2"), as_org=F.lit("o")))
    cities = block(nations.where(n % 2 == 1), wide, postal_code=F.lit("1"), city=F.concat(F.lit("c"), text(n)), country_code=F.lit("T"), country_name=F.lit("Town"))
    found = joins.geolocated(rows, "ip", countries, systems, cities)
    return found.select("k", F.col("country_name").alias("country"), "country_code", "asn", "city", "has_data")


@query("jn15_netbios_wack", "select page_id as txid, 2 as packets_waited, 7000 as latency_us from pages where page_id is not null and page_id < 65536 and page_id % 3 < 2")
def jn15_wack(spark: SparkSession, d: str) -> DataFrame:
    """A name query, a WACK after 3 ms, and for two thirds of the pages the answer after 7 ms."""
    n = F.col("page_id")
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(us).alias("after"), F.lit(flags).alias("flags")) for k, us, flags in ((0, 0, "0110"), (1, 3000, "BC00"), (2, 7000, "8500"))))
    rows = table(spark, d, "pages").where("page_id is not null and page_id < 65536").select("page_id", F.explode(steps).alias("s")).where((F.col("s.k") < 2) | (n % 3 < 2))
    name = F.lit("20" + "4845" * 16 + "00" + "00200001")
    sent = rows.select("page_id", F.lit("UDP").alias("protocol"), F.lit("10.0.0.1").alias("local_ip"), F.lit(137).alias("local_port"), F.lit("10.0.0.255").alias("remote_ip"), F.lit(137).alias("remote_port"), (F.col("s.k") == 0).alias("is_outgoing"), (n * 10_000 + F.col("s.after")).alias("us"), (n * 4 + F.col("s.k")).alias("frame_no"), F.unhex(F.concat(_hex(n, 2), F.col("s.flags"), F.lit("0001000000000000"), name)).alias("payload"))
    dissected = dpi.dissect(sent).withColumn("txid", F.col("dpi.txid").cast("long"))
    found = latency.netbios(dissected, ["local_ip", "txid"])
    waited = dissected.where("not is_outgoing").groupBy("txid").agg(F.count(F.lit(1)).cast("int").alias("packets_waited"))
    return found.join(waited, "txid").select("txid", "packets_waited", F.col("latency_us").cast("int"))


@query("fl10_split_hello", f"select local_ip, host as sni, ['h2'] as alpn, 'HTTPS (' || host || ')' as application from ({_PAGES})")
def fl10(spark: SparkSession, d: str) -> DataFrame:
    """A hello in three segments over the wrap of the sequence numbers: the name is cut in the first, the last two come in the wrong order, the second twice."""
    n = F.col("page_id")
    hello = _hello(F.concat(_label(n), F.lit(".example.com")))
    pages = table(spark, d, "pages").where(n.isNotNull()).select("page_id", F.unhex(F.concat(F.lit("160301"), _hex(F.length(hello) / 2, 2), hello)).alias("h"))
    steps = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, a, b in ((0, 0, 65), (1, 75, 400), (2, 65, 10), (3, 65, 10))))
    sent = pages.select("page_id", "h", F.explode(steps).alias("s"))
    rows = sent.select("page_id", F.lit("TCP").alias("protocol"), F.concat_ws(".", F.lit("10"), *((F.floor(n / 250**e) % 250).cast("string") for e in (2, 1, 0))).alias("local_ip"), F.lit(40000).alias("local_port"), F.lit("203.0.113.9").alias("remote_ip"), F.lit(443).alias("remote_port"), F.lit(True).alias("is_outgoing"), (n * 10 + F.col("s.t")).alias("us"), (n * 10 + F.col("s.t")).alias("frame_no"), ((F.lit((1 << 32) - 70) + F.col("s.a")) % (1 << 32)).alias("seq"), F.expr("substring(h, s.a + 1, s.b)").alias("payload")).withColumn("packet_len", F.length("payload").cast("long"))
    found = dpi.with_hellos(dpi.connections(dpi.dissect(rows)), rows)
    return found.select("local_ip", F.col("dpi.sni").alias("sni"), F.col("dpi.alpn").alias("alpn"), dpi.display(F.col("dpi")).alias("application"))


def _captured(name: str, text: str, sql: str) -> None:
    query(f"sc4_{name}", P + f" select frame_no from packets where {sql}")(lambda s, d: packets(s, d).where(capture.compiled(text)).select("frame_no"))


_captured("ports", "tcp and (dst port 443 or 80)", "protocol = 'TCP' and is_outgoing and remote_port in (443, 80)")
_captured("nets", "src net 203.0.113.0/28 or (udp and not portrange 53-123)", "(not is_outgoing and cast(split_part(remote_ip, '.', 4) as integer) < 16) or (protocol = 'UDP' and remote_port not between 53 and 123)")
_captured("hosts", "!host 203.0.113.7 && greater 500 and less 5000", "remote_ip <> '203.0.113.7' and packet_len between 500 and 5000")
