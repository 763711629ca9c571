"""Application inspection: which protocol a payload speaks, its fields, and how they read.

dissect() tries the dissectors in one fixed order, each where its port or its
signature asks for it; the first that accepts a payload names the application. All
fields of all protocols stand in one struct, absent ones NULL, so later steps
(connections, filters, texts) prune what they do not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import authoritative_hostname, coded
from netquarry.operators import decode, quic
from netquarry.plans.packets import FLOW

# NTP modes by number, DHCP messages by option 53, ICMP and IGMP states by type.
NTP_MODES = {0: "Reserved", 1: "SymActive", 2: "SymPassive", 3: "Client", 4: "Server", 5: "Broadcast", 6: "Control", 7: "Private"}
DHCP_MESSAGES = {1: "DISCOVER", 2: "OFFER", 3: "REQUEST", 4: "DECLINE", 5: "ACK", 6: "NAK", 7: "RELEASE", 8: "INFORM"}
ICMP_STATES = {3: "DEST_UNREACH", 11: "TIME_EXCEEDED"}
QUIC_STATES = {"Initial": "QUIC_INITIAL", "Retry": "QUIC_INITIAL", "Version Negotiation": "QUIC_INITIAL", "Handshake": "QUIC_HANDSHAKE", "Handshaking": "QUIC_HANDSHAKE", "0-RTT": "QUIC_HANDSHAKE", "1-RTT": "QUIC_CONNECTED", "Connected": "QUIC_CONNECTED", "Draining": "QUIC_DRAINING", "Closed": "QUIC_CLOSED"}
IGMP_STATES = {0x11: "QUERY", 0x12: "REPORT_V1", 0x16: "REPORT_V2", 0x22: "REPORT_V3", 0x17: "LEAVE_GROUP"}

# Commands that no mail or news protocol shares with FTP.
FTP_ONLY = "ACCT|CWD|CDUP|SMNT|REIN|PORT|PASV|TYPE|STRU|STOR|STOU|APPE|ALLO|REST|RNFR|RNTO|ABOR|RMD|MKD|PWD|NLST|SITE|SYST|FEAT|OPTS|EPSV|EPRT|PBSZ|PROT|CCC|SIZE|MDTM|MLSD|MLST"

#: Every field of the struct; the texts among them are what a general filter searches.
TEXT_FIELDS = ["host", "path", "method", "user_agent", "sni", "query", "software", "command", "args", "username", "system", "hostname", "target", "client_id", "topic", "client", "community"]
FIELDS = ["app", *TEXT_FIELDS, "kind", "version", "code", "is_response", "ips", "alpn", "cipher", "txid", "algorithms", "transmit"]


def dissect(packets: DataFrame) -> DataFrame:
    """packets with `dpi`; NULL without a payload or a protocol that takes it."""
    data, tcp, udp = F.col("payload"), F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    some = F.length(data) > 0
    port = lambda *p: F.col("local_port").isin(*p) | F.col("remote_port").isin(*p)
    text = F.decode(data, "iso-8859-1")
    asked = lambda yes: F.when(some & yes, data)
    hello = port(443) | F.coalesce((F.substring(data, 1, 1) == F.lit(b"\x16")) & (F.substring(data, 2, 1) == F.lit(b"\x03")), F.lit(False))
    seen = packets.withColumns({"__tls": decode.tls(asked(tcp & hello)), "__dns": decode.dns(asked(udp & port(53, 5355))), "__mdns": decode.mdns(asked(udp & port(5353) & ~port(53))), "__dhcp": decode.dhcp(asked(udp & port(67, 68)))})
    found = {
        "http": F.when(tcp & some, decode.http(text)),
        "bt": F.when(tcp & some, decode.bittorrent(data)),
        "mqtt": F.when(tcp & some & (port(1883) | decode.is_mqtt(data)), decode.mqtt(data)),
        "ssh": F.when(tcp & some, decode.ssh(data, text)),
        "ftp": F.when(tcp & some & (port(21) | text.rlike(rf"(?i)^(?:{FTP_ONLY})(?:[ \r\n]|$)")), decode.ftp(text)),
        "quic": F.when(udp & some & port(443) & quic.is_quic(data), quic.brief(data)),
        "nbns": F.when(udp & some & port(137), decode.netbios_names(data)),
        "nbdgm": F.when(udp & some & port(138), decode.netbios_datagrams(data)),
        "snmp": F.when(udp & some & port(161, 162), decode.snmp(data)),
        "btudp": F.when(udp & some, decode.bittorrent_udp(data)),
        "ntp": F.when(udp & some & port(123), decode.ntp(data)),
        "ssdp": F.when(udp & some & port(1900), decode.ssdp(text)),
        "stun": F.when(udp & some, decode.stun(data)),
    }
    # Generators of one row, here and below: what reads single fields later is not put in place of the dissectors, once a field.
    told = seen.select("*", F.explode(F.array(F.struct(*(v.alias(n) for n, v in found.items())))).alias("__d"))
    c = lambda n: F.col(n if n.split(".")[0] in ("__tls", "__dns", "__mdns", "__dhcp") else n.replace("__", "__d."))
    # in the order of inspection; each accepts by its own fields
    cases = [
        (c("__http").isNotNull(), "HTTP", {"host": c("__http.host"), "path": c("__http.path"), "method": c("__http.method"), "user_agent": c("__http.user_agent"), "version": c("__http.version"), "code": c("__http.status")}),
        (tcp & (c("__tls.record").isNotNull() | (some & port(443) & F.substring(data, 1, 2).isin(F.lit(b"\x16\x03"), F.lit(b"\x17\x03")))), "HTTPS", {"sni": c("__tls.sni"), "alpn": c("__tls.alpn"), "cipher": c("__tls.cipher"), "kind": c("__tls.record")}),
        (c("__bt").isNotNull(), "BitTorrent", {"client": c("__bt.client"), "kind": F.lit("Peer"), "txid": c("__bt.info_hash")}),
        (c("__mqtt").isNotNull(), "MQTT", {"kind": c("__mqtt.type"), "client_id": c("__mqtt.client_id"), "topic": c("__mqtt.topic"), "version": c("__mqtt.version").cast("string")}),
        (c("__ssh").isNotNull(), "SSH", {"software": c("__ssh.software"), "version": c("__ssh.version"), "kind": c("__ssh.state"), "algorithms": c("__ssh.algorithms")}),
        (c("__ftp").isNotNull(), "FTP", {"command": c("__ftp.command"), "args": c("__ftp.args"), "code": c("__ftp.code"), "username": c("__ftp.username"), "software": c("__ftp.software"), "system": c("__ftp.system")}),
        (udp & port(53) & c("__dns.txid").isNotNull(), "DNS", "__dns"),
        (udp & port(443) & quic.is_quic(data), "QUIC", {"kind": c("__quic.kind"), "version": quic.version_name(c("__quic.version")), "txid": F.nullif(F.lower(F.hex(c("__quic.dcid"))), F.lit(""))}),
        (udp & port(5353) & c("__mdns.txid").isNotNull(), "mDNS", "__mdns"),
        (c("__dhcp.message").isNotNull(), "DHCP", {"kind": coded(c("__dhcp.message"), DHCP_MESSAGES), "hostname": c("__dhcp.hostname")}),
        (c("__ntp").isNotNull(), "NTP", {"version": c("__ntp.version").cast("string"), "kind": coded(c("__ntp.mode"), NTP_MODES), "txid": c("__ntp.origin"), "transmit": c("__ntp.transmit")}),
        (udp & port(5355) & c("__dns.txid").isNotNull(), "LLMNR", "__dns"),
        (c("__ssdp").isNotNull(), "SSDP", {"kind": c("__ssdp.method"), "target": c("__ssdp.target")}),
        *((c(n).isNotNull(), "NetBIOS", {"kind": c(f"{n}.service"), "command": c(f"{n}.opcode"), "hostname": c(f"{n}.name"), "txid": c(f"{n}.txid").cast("string"), "is_response": c(f"{n}.is_response"), "code": c(f"{n}.code")}) for n in ("__nbns", "__nbdgm")),
        (c("__snmp").isNotNull(), "SNMP", {"kind": c("__snmp.pdu"), "version": c("__snmp.version"), "community": c("__snmp.community")}),
        (c("__stun").isNotNull(), "STUN", {"kind": c("__stun.class"), "code": c("__stun.method"), "txid": c("__stun.txid"), "software": c("__stun.software")}),
        (c("__btudp").isNotNull(), "BitTorrent", {"kind": c("__btudp.kind"), "method": c("__btudp.method")}),
    ]
    dns = lambda n: {"query": c(f"{n}.name"), "is_response": c(f"{n}.is_response"), "ips": c(f"{n}.ips"), "code": c(f"{n}.rcode"), "kind": c(f"{n}.qtype").cast("string"), "txid": c(f"{n}.txid").cast("string")}
    types = {"code": "int", "is_response": "boolean", "ips": "array<string>", "alpn": "array<string>", "cipher": "int", "algorithms": "array<string>"}

    absent = {n: F.lit(None).cast(types.get(n, "string")).alias(n) for n in FIELDS}
    whole = None
    for test, app, values in cases:
        given = {"app": F.lit(app)} | (values if isinstance(values, dict) else dns(values))
        one = F.struct(*(given[n].cast(types.get(n, "string")).alias(n) if n in given else absent[n] for n in FIELDS))
        whole = F.when(test, one) if whole is None else whole.when(test, one)
    return told.select(*packets.columns, F.explode(F.array(whole)).alias("dpi"))


def _with(head: Column, *details: Column) -> Column:
    detail = F.coalesce(*details)
    return F.when(detail.isNotNull(), F.concat(head, F.lit(" ("), detail, F.lit(")"))).otherwise(head)


def display(dpi: Column) -> Column:
    """The application as a listing shows it."""
    f, app = lambda n: dpi[n], dpi["app"]
    two = F.concat_ws(" ", app, f("kind"))
    ftp = F.when(f("command").isNotNull(), F.concat_ws(" ", app, f("command"), f("args"))).when(f("code").isNotNull(), _with(F.concat_ws(" ", app, f("code").cast("string")), f("software"))).otherwise(app)
    return (
        F.when(app == "HTTP", _with(app, f("host")))
        .when(app.isin("HTTPS", "QUIC"), _with(app, f("sni")))
        .when(app.isin("DNS", "mDNS", "LLMNR"), _with(app, f("query")))
        .when(app == "SSH", _with(app, F.split_part(f("software"), F.lit("_"), F.lit(1))))
        .when(app == "NTP", F.concat(F.lit("NTP (v"), f("version"), F.lit(" "), f("kind"), F.lit(")")))
        .when(app == "DHCP", _with(two, f("hostname")))
        .when(app == "SSDP", _with(two, f("target")))
        .when(app == "MQTT", _with(two, f("topic"), f("client_id")))
        .when(app == "STUN", F.concat_ws(" ", app, F.when(f("code") == 1, "Binding").otherwise(F.format_string("0x%03x", f("code"))), f("kind")))
        .when(app == "SNMP", _with(F.concat_ws(" ", app, f("version"), f("kind")), f("community")))
        .when(app == "NetBIOS", _with(two, f("hostname")))
        .when((app == "BitTorrent") & (f("kind") == "DHT"), _with(F.lit("BT DHT"), f("method")))
        .when((app == "BitTorrent") & (f("kind") == "uTP"), "BT uTP")
        .when(app == "BitTorrent", _with(app, f("client")))
        .when(app == "FTP", ftp)
        .otherwise(app)
    )


def hostname(dpi: Column) -> Column:
    """The host of an HTTP request or the server name of a TLS hello."""
    return F.when(dpi["app"] == "HTTP", dpi["host"]).when(dpi["app"].isin("HTTPS", "QUIC"), dpi["sni"])


def authoritative(dpi: Column) -> Column:
    """The host that a flow names itself, if it is whole and a name."""
    return authoritative_hostname(hostname(dpi))


def domain(dpi: Column) -> Column:
    """The name for event lines: a DNS query's, else the hostname."""
    return F.when(dpi["app"] == "DNS", dpi["query"]).otherwise(hostname(dpi))


def state(protocol: Column, tcp_state: Column, dpi: Column, idle_s: Column, icmp_type: Column, icmp_id: Column, igmp_type: Column, igmp_group: Column, op: Column, target_ip: Column, sender_mac: Column, vendor: Column) -> Column:
    """The state of a connection as a listing shows it, by protocol."""
    app, kind = dpi["app"], dpi["kind"]
    answer = F.when(dpi["is_response"], "RESPONSE").otherwise("QUERY")
    udp = (
        F.when(app.isin("DNS", "mDNS", "LLMNR"), F.concat(F.upper(app), F.lit("_"), answer))
        .when(app.isin("HTTP", "HTTPS", "SSH", "MQTT", "FTP"), F.concat(app, F.lit("_UDP")))
        .when(app == "QUIC", coded(kind, QUIC_STATES, F.lit("QUIC_UNKNOWN")))
        .when(app == "NTP", "NTP")
        .when(app == "BitTorrent", "BT_UDP")
        .when(app.isin("DHCP", "SSDP", "STUN", "SNMP", "NetBIOS"), F.concat(F.upper(app), F.lit("_"), kind))
        .otherwise(F.when(idle_s > 60, "UDP_STALE").when(idle_s > 30, "UDP_IDLE").otherwise("UDP_ACTIVE"))
    )
    echo = lambda short, long: F.when(icmp_id.isNotNull(), F.concat(F.lit(f"{short}("), icmp_id.cast("string"), F.lit(")"))).otherwise(long)
    icmp = F.when(icmp_type.isin(8, 128), echo("ECHO_REQ", "ECHO_REQUEST")).when(icmp_type.isin(0, 129), echo("ECHO_REP", "ECHO_REPLY")).otherwise(coded(icmp_type, ICMP_STATES, F.lit("ICMP_OTHER")))
    igmp = F.concat(coded(igmp_type, IGMP_STATES, F.lit("IGMP_OTHER")), F.coalesce(F.concat(F.lit("("), igmp_group, F.lit(")")), F.lit("")))
    arp = F.concat(F.when(op == "request", F.concat(F.lit("ARP_WHO_HAS "), target_ip)).otherwise(F.concat(F.lit("ARP_IS_AT "), sender_mac)), F.coalesce(F.concat(F.lit(" ("), vendor, F.lit(")")), F.lit("")))
    return F.when(protocol == "TCP", tcp_state).when(protocol == "UDP", udp).when(protocol == "ICMP", icmp).when(protocol == "IGMP", igmp).when(protocol == "ARP", arp)


# Applications of which a flow keeps its first packet's fields, and by application what is kept of the last packet that has it.
UNMERGED = ("NTP", "mDNS", "LLMNR", "DHCP", "SNMP", "SSDP", "STUN")
LATEST = {"kind": ("HTTPS", "QUIC", "MQTT"), "command": ("NetBIOS", "FTP"), "args": ("FTP",), "code": ("DNS", "NetBIOS", "FTP"), "txid": ("DNS", "NetBIOS")}
MOST_LISTED = 64
PARTIAL = "[PARTIAL]"


def connections(dissected: DataFrame, by: list[str] = FLOW) -> DataFrame:
    """Flows (or other groups of packets) with the merged inspection of their packets.

    The application is the first that was recognised, and packets of others add nothing to it. Fields keep the first value
    seen, but for LATEST; of UNMERGED applications the first packet stays. A whole server name replaces a cut-off one; a
    response marks the flow for good; SSH states only go forward; addresses of DNS answers and SSH algorithms are united
    in the order seen, MOST_LISTED at most, and what a packet of an established SSH connection names replaces what was
    named before.

    Each value is aggregated with its time, as least or greatest, so that sums can be summed up again: first by flow,
    application and listed entry, with partial sums before the shuffle (a flow of many answers is spread over its
    addresses), then the few rows of an application, then those of a flow.
    """
    out, d = F.col("is_outgoing"), F.col("dpi")
    lists = F.when(d["app"] == "DNS", d["ips"]).when(d["app"] == "SSH", d["algorithms"])
    packets = dissected.select(*by, F.struct("us", "frame_no").alias("__o"), F.col("packet_len").alias("__len"), out.alias("__out"), d.alias("__d"), F.posexplode_outer(lists).alias("__n", "__value"))
    o, f = F.col("__o"), lambda n: F.col("__d")[n]
    once = F.coalesce(F.col("__n") == 0, F.lit(True))  # a packet counts once, however many entries it lists
    at = lambda n, test=None: F.when(f(n).isNotNull() if test is None else test, F.struct(o.alias("o"), f(n).alias("v")))
    rank = F.array_position(F.array(*map(F.lit, decode.SSH_STATES)), F.when(f("app") == "SSH", f("kind")))
    least = {f"__a_{n}": at(n) for n in FIELDS if n not in ("app", "ips", "algorithms", "is_response", "alpn")}
    least |= {"__open": F.struct(o.alias("o"), F.col("__d").alias("v")), "__whole_sni": at("sni", ~f("sni").endswith(PARTIAL)), "__a_alpn": at("alpn", F.size(f("alpn")) > 0)}
    most = {f"__z_{n}": at(n) for n in LATEST} | {"__a_is_response": f("is_response"), "__rank": rank, "__last": o}
    most["__settled"] = F.when((f("app") == "SSH") & (f("kind") == "Established") & (F.size(f("algorithms")) > 0), o)
    sums = {"bytes_sent": F.when(once & F.col("__out"), F.col("__len")).otherwise(0), "bytes_received": F.when(once & ~F.col("__out"), F.col("__len")).otherwise(0), "packets": once.cast("long")}
    gathered = lambda value: [*(F.sum(value(n, v)).alias(n) for n, v in sums.items()), *(F.min(value(n, v)).alias(n) for n, v in least.items()), *(F.max(value(n, v)).alias(n) for n, v in most.items())]
    entries = packets.groupBy(*by, f("app").alias("app"), "__value").agg(*gathered(lambda n, v: v), F.min(F.struct("__o", "__n")).alias("__seen"))
    place = F.row_number().over(Window.partitionBy(*by, "app").orderBy(F.col("__value").isNull(), "__seen"))
    entry = F.when(F.col("__value").isNotNull() & (F.col("__p") <= MOST_LISTED), F.struct("__seen", F.col("__last").alias("last"), F.col("__value").alias("value")))
    held = entries.withColumn("__p", place).groupBy(*by, "app").agg(*gathered(lambda n, v: F.col(n)), F.array_sort(F.collect_list(entry)).alias("__listed"))
    kept = F.filter("__listed", lambda x: F.col("__settled").isNull() | (x["last"] >= F.col("__settled")))
    united = F.transform(kept, lambda x: x["value"])

    def told(n: str) -> Column:
        if n == "app":
            return F.col(n)
        first, app = F.col(f"__open.v.{n}"), F.col("app")
        if n in ("ips", "algorithms"):
            return F.when(app == ("DNS" if n == "ips" else "SSH"), united).otherwise(first)
        value = F.col(f"__a_{n}") if n == "is_response" else F.coalesce("__whole_sni.v", "__a_sni.v") if n == "sni" else F.col(f"__a_{n}.v")
        if n in LATEST:
            value = F.when(app.isin(*LATEST[n]), F.col(f"__z_{n}.v")).otherwise(value)
        if n == "kind":
            value = F.when(app == "SSH", F.element_at(F.array(*map(F.lit, decode.SSH_STATES)), F.col("__rank").cast("int"))).otherwise(value)
        if n == "version":  # of the first packet, where an application has one in every packet
            value = F.when(app.isin("HTTP", "QUIC"), first).otherwise(value)
        return F.when(app.isin(*UNMERGED), first).otherwise(value)

    one = held.select(*by, "app", *sums, F.col("__open.o").alias("__first"), "__last", F.struct(*(told(n).alias(n) for n in FIELDS)).alias("dpi"))
    found = one.groupBy(*by).agg(*(F.sum(n).alias(n) for n in sums), F.min("__first.us").alias("__c"), F.max("__last.us").alias("last_us"), F.min_by("dpi", F.when(F.col("app").isNotNull(), F.col("__first"))).alias("dpi"))
    return found.select(*by, *sums, *([] if "created_us" in by else [F.col("__c").alias("created_us")]), "last_us", "dpi")


def searchable(rows: DataFrame) -> DataFrame:
    """rows with the columns that filters search: the application as shown, and every text that inspection found, under its filter name."""
    dpi = F.col("dpi")
    texts = {f"dpi_{n}": dpi[n] for n in TEXT_FIELDS if n not in ("sni", "host", "user_agent", "path")}
    return rows.withColumns({"application": display(dpi), "sni": authoritative_hostname(dpi["sni"]), "host": dpi["host"], "user_agent": dpi["user_agent"], "path": dpi["path"], "dns_query": dpi["query"], "alpn": F.array_join(dpi["alpn"], " "), "dpi_code": dpi["code"].cast("string"), **texts})


def with_quic(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """flows (FLOW, dpi) with what QUIC's CRYPTO data shows by connection: server name, ALPN and version in dpi, its state as the kind."""
    found = quic.flows(packets).select(*FLOW, F.col("state").alias("__state"), F.col("sni").alias("__sni"), F.col("alpn").alias("__alpn"), F.col("version").alias("__version"))
    dpi = F.col("dpi")
    told = dpi.withField("kind", F.col("__state")).withField("sni", F.col("__sni")).withField("alpn", F.col("__alpn")).withField("version", F.col("__version"))
    return flows.join(found, FLOW, "left").withColumn("dpi", F.when((dpi["app"] == "QUIC") & F.col("__state").isNotNull(), told).otherwise(dpi)).drop("__state", "__sni", "__alpn", "__version")


def hellos(packets: DataFrame) -> DataFrame:
    """FLOW, sni, alpn and version of TCP flows whose ClientHello came in several segments, put together by sequence number.

    The flow's first outgoing segment that begins a hello sets the start; segments of the same direction within 2^16 bytes of it
    count, in any order, the first of each place. A name that is still cut off is marked as in tls().
    """
    data, order = F.col("payload"), F.struct("us", "frame_no")
    out = packets.where((F.col("protocol") == "TCP") & F.col("is_outgoing") & (F.length(data) > 0))
    begins = (F.substring(data, 1, 2) == F.lit(b"\x16\x03")) & (F.substring(data, 6, 1) == F.lit(b"\x01"))
    starts = out.where(begins).groupBy(*FLOW).agg(F.min_by(F.struct("seq", F.length(data).alias("had"), (decode.number(data, 3, 2) + 5).alias("wanted")), order).alias("s"))
    cut = starts.where("s.had < s.wanted").select(*FLOW, F.col("s.seq").alias("__base"), F.col("s.wanted").alias("__wanted"))
    place = F.pmod(F.col("seq") - F.col("__base"), F.lit(1 << 32))
    pieces = out.join(cut, FLOW).withColumn("offset", place).where(F.col("offset") < F.col("__wanted"))
    once = pieces.groupBy(*FLOW, "__wanted", "offset").agg(F.min(F.struct("us", "frame_no", F.struct("offset", F.col("payload").alias("data")).alias("c"))).alias("p"))
    lists = once.groupBy(*FLOW).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["c"]).alias("parts"))
    whole = quic.step(lists, hello=quic.assembled(F.col("parts"))).withColumn("__tls", decode.tls(F.col("hello")))
    return whole.select(*FLOW, F.col("__tls.sni").alias("sni"), F.col("__tls.alpn").alias("alpn"), F.col("__tls.version").alias("version"))


def with_hellos(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """flows (FLOW, dpi) whose cut-off or missing server name is replaced by that of the hello put together from its segments."""
    found = hellos(packets).select(*FLOW, F.col("sni").alias("__sni"), F.col("alpn").alias("__alpn"))
    dpi = F.col("dpi")
    better = (dpi["app"] == "HTTPS") & F.col("__sni").isNotNull() & (dpi["sni"].isNull() | dpi["sni"].endswith("[PARTIAL]"))
    told = dpi.withField("sni", F.col("__sni")).withField("alpn", F.coalesce(F.when(F.size("__alpn") > 0, F.col("__alpn")), dpi["alpn"]))
    return flows.join(found, FLOW, "left").withColumn("dpi", F.when(better, told).otherwise(dpi)).drop("__sni", "__alpn")


def ingest(frames: DataFrame, local: DataFrame) -> DataFrame:
    """From captured frames to inspected connections: decode, dissect, fold, and put hellos over several packets together."""
    packets = decode.packets(frames, local)
    return with_hellos(with_quic(connections(dissect(packets)), packets), packets)
