"""Payloads to application fields, by native byte expressions where a format allows it.

Malformed payloads give NULL fields. Frames are decoded in netquarry.operators.frames.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions.net import coded, looked_up, valid_hostname
from netquarry.operators.frames import packets as packets  # the frame decoder, beside the payload decoders


def number(data: Column, at: Column | int, n: int) -> Column:
    """n bytes at a zero-based offset as a long; NULL past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(n))
    return F.when((F.length(part) == n) & (at >= 0), F.conv(F.hex(part), 16, 10).cast("long"))


# -- text dissectors -----------------------------------------------------------


def http(text: Column) -> Column:
    """Method, path, version, status, host and user agent of an HTTP/1 message; NULL if it is none. The last of repeated headers wins."""
    methods = "GET|POST|PUT|DELETE|HEAD|OPTIONS|CONNECT|TRACE|PATCH"
    request, status = rf"^({methods}) (\S+) (HTTP/(?:1\.[01]|2))(?=[\r\n]|$)", r"^(HTTP/(?:1\.[01]|2)) ([1-5]\d\d)"
    get = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    head = F.split_part(F.regexp_replace(text, "\r\n", "\n"), F.lit("\n\n"), F.lit(1))
    header = lambda name: F.nullif(F.trim(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(head, F.lit(rf"(?im)^{name}:[ \t]*(.*)$"), F.lit(1))), -1)), F.lit(""))
    info = F.struct(get(request, 1).alias("method"), get(request, 2).alias("path"), F.coalesce(get(request, 3), get(status, 1)).alias("version"), get(status, 2).cast("int").alias("status"), header("host").alias("host"), header("user-agent").alias("user_agent"))
    return F.when(text.rlike(request) | text.rlike(status), info)


# SSH message numbers by what they say of a connection, all that a packet may carry, and algorithms looked for by name.
SSH_STATES = ["Banner", "KeyExchange", "Authentication", "Established"]
SSH_SAYS = {20: 1, 21: 1, 50: 2, 51: 2, 52: 3} | dict.fromkeys(range(90, 101), 3)
SSH_MESSAGES = [*range(1, 5), *sorted(SSH_SAYS), 80]
SSH_ALGORITHMS = ["diffie-hellman-group14-sha256", "ecdh-sha2-nistp256", "aes128-ctr", "aes256-ctr", "aes128-gcm", "aes256-gcm", "ssh-rsa", "ssh-ed25519", "ecdsa-sha2-nistp256", "hmac-sha2-256", "hmac-sha2-512"]


def _ssh_packet(head: Column) -> Column:
    """Whether six bytes may begin a packet: its length, its padding inside that, a known message."""
    size, padding = number(head, 0, 4), number(head, 4, 1)
    return F.coalesce(size.between(8, 35_000) & (padding >= 4) & (padding + 1 < size) & number(head, 5, 1).isin(SSH_MESSAGES), F.lit(False))


def ssh(data: Column, text: Column) -> Column:
    """Banner, state by the first telling message anywhere in the payload, and named algorithms; NULL without a banner or a packet at its start.

    `text` is the payload as ISO-8859-1. Places that may begin a telling message are found by one look-ahead expression,
    overlapping ones too, and only those are tested as packets.
    """
    telling = "".join(rf"\x{n:02x}" for n in sorted(SSH_SAYS))
    places = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(\x00\x00[\x00-\x88].[\x04-\xff][{telling}]))"), F.lit(1))
    heads = F.filter(F.transform(places, lambda t: F.encode(t, "iso-8859-1")), _ssh_packet)
    said = F.when(F.size(heads) > 0, coded(number(F.get(heads, F.lit(0)), 5, 1), SSH_SAYS)).otherwise(0)
    names = F.filter(F.array(*map(F.lit, SSH_ALGORITHMS)), lambda a: F.contains(text, a))
    banner = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    info = F.struct(banner(r"(?m)^SSH-([^-\r\n]+)").alias("version"), F.trim(banner(r"(?m)^SSH-[^-\r\n]+-([^\r\n]*)")).alias("software"), F.element_at(F.array(*map(F.lit, SSH_STATES)), said + 1).alias("state"), names.alias("algorithms"))
    return F.when(text.startswith("SSH-1.") | text.startswith("SSH-2.") | _ssh_packet(data), info)


def ftp(text: Column) -> Column:
    """Command and arguments, or reply code and message."""
    verbs = "USER|PASS|ACCT|CWD|CDUP|QUIT|PORT|PASV|TYPE|RETR|STOR|LIST|NLST|SYST|STAT|HELP|NOOP|FEAT|EPSV|EPRT|MLSD|MDTM|SIZE|DELE|RNFR|RNTO|MKD|RMD|PWD|AUTH|PBSZ|PROT|REST|ABOR|APPE|OPTS"
    get = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    command, reply = rf"(?i)^({verbs})(?: ([^\r\n]*))?\r?\n", r"^([1-5][0-5]\d)[ -]([^\r\n]*)"
    last, token = F.coalesce(get(r"^(\d{3}) ", 1), F.lit("")), get(r"^\d{3} \s*([^\s]+)", 1)  # a line with a continuation mark names nothing
    info = F.struct(F.upper(get(command, 1)).alias("command"), get(command, 2).alias("args"), get(reply, 1).cast("int").alias("code"), get(reply, 2).alias("message"), F.when(F.upper(get(command, 1)) == "USER", get(command, 2)).alias("username"), F.when(last.startswith("220"), token).alias("software"), F.when(last.startswith("215"), token).alias("system"))
    return F.when(text.rlike(command) | text.rlike(reply), info)


def ssdp(text: Column) -> Column:
    method = F.when(text.startswith("M-SEARCH"), "M-SEARCH").when(text.startswith("NOTIFY"), "NOTIFY").when(text.startswith("HTTP/1.1 200"), "RESPONSE")
    target = F.nullif(F.trim(F.regexp_extract(text, r"(?im)^(?:ST|NT):[ \t]*(\S[^\r\n]*)", 1)), F.lit(""))
    return F.when(method.isNotNull(), F.struct(method.alias("method"), target.alias("target")))


# -- binary dissectors ---------------------------------------------------------


def ntp(data: Column) -> Column:
    first = number(data, 0, 1)
    version = F.shiftright(first, 3).bitwiseAND(7)
    info = F.struct(version.alias("version"), first.bitwiseAND(7).alias("mode"), number(data, 1, 1).alias("stratum"), F.lower(F.hex(F.substring(data, 25, 8))).alias("origin"), F.lower(F.hex(F.substring(data, 41, 8))).alias("transmit"))
    return F.when((F.length(data) >= 48) & version.between(1, 4), info)


def stun_software(data: Column) -> Column:
    """The SOFTWARE text of a STUN message, 128 bytes at most; NULL if an attribute before it runs over the message's end."""
    stop = number(data, 2, 2) + 20

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        kind, size = number(data, at, 2), number(data, at + 2, 2)
        fits = (at + 4 <= stop) & (at + 4 + size <= F.least(stop, F.length(data)))
        found = F.substring(data, (at + 5).cast("int"), F.least(size, F.lit(128)).cast("int"))
        text = F.when(fits & (kind == 0x8022), F.when(F.is_valid_utf8(found.cast("string")), F.rtrim(found.cast("string"), F.lit("\0"))))
        # a place past the end stops the walk: after the text, and after an attribute that does not fit
        return F.struct(F.when(fits & (kind != 0x8022), at + 4 + F.ceil(size / 4) * 4).otherwise(1 << 20).cast("long").alias("at"), F.coalesce(s["text"], text).alias("text"))

    begin = F.struct(F.lit(20).cast("long").alias("at"), F.lit(None).cast("string").alias("text"))
    return F.when(stop > 20, F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(stop / 4) - 5, F.lit(1))), begin, step, lambda s: s["text"]))


def stun(data: Column) -> Column:
    """Class, method, transaction id and software of a STUN message with the magic cookie."""
    kind = number(data, 0, 2)
    low, high = F.shiftright(kind, 4).bitwiseAND(1), F.shiftright(kind, 8).bitwiseAND(1)
    names = F.array(*map(F.lit, ["Request", "Indication", "Success", "Error"]))
    method = kind.bitwiseAND(0xF) + F.shiftright(kind, 5).bitwiseAND(7) * 16 + F.shiftright(kind, 9).bitwiseAND(0x1F) * 128
    return F.when((F.length(data) >= 20) & (number(data, 4, 4) == 0x2112A442) & (kind < 0x4000), F.struct(F.element_at(names, (high * 2 + low + 1).cast("int")).alias("class"), method.alias("method"), F.lower(F.hex(F.substring(data, 9, 12))).alias("txid"), stun_software(data).alias("software")))


def is_mqtt(data: Column) -> Column:
    """A CONNECT message by its flags, its length, and the protocol name; other types are too weak a sign."""
    size = F.when(number(data, 1, 1) < 128, 1).when(number(data, 2, 1) < 128, 2).when(number(data, 3, 1) < 128, 3).when(number(data, 4, 1) < 128, 4)
    part = lambda k: F.when(size > k, number(data, k + 1, 1).bitwiseAND(127) * 128**k).otherwise(0)
    fits = 1 + size + part(0) + part(1) + part(2) + part(3) <= F.length(data) + 4
    return F.coalesce((number(data, 0, 1) == 0x10) & fits & F.decode(F.substring(data, size + 4, F.lit(4)), "iso-8859-1").isin("MQTT", "MQIs"), F.lit(False))


def mqtt(data: Column) -> Column:
    names = F.array(*map(F.lit, ["CONNECT", "CONNACK", "PUBLISH", "PUBACK", "PUBREC", "PUBREL", "PUBCOMP", "SUBSCRIBE", "SUBACK", "UNSUBSCRIBE", "UNSUBACK", "PINGREQ", "PINGRESP", "DISCONNECT", "AUTH"]))
    kind = F.shiftright(number(data, 0, 1), 4)
    n = F.when(number(data, 1, 1) < 128, 1).when(number(data, 2, 1) < 128, 2).when(number(data, 3, 1) < 128, 3).otherwise(4)  # bytes of the length
    connect = (kind == 1) & F.decode(F.substring(data, n + 4, F.lit(4)), "utf-8").isin("MQTT", "MQIs")
    version = F.when(connect, number(data, n + 7, 1))
    client = F.when(connect & (version < 5), F.decode(F.substring(data, n + 14, number(data, n + 11, 2).cast("int")), "utf-8"))
    topic = F.when(kind == 3, F.decode(F.substring(data, n + 4, number(data, n + 1, 2).cast("int")), "utf-8"))
    qos = F.when(kind == 3, F.shiftright(number(data, 0, 1), 1).bitwiseAND(3))
    return F.when(kind.between(1, 15), F.struct(F.element_at(names, kind.cast("int")).alias("type"), version.alias("version"), F.nullif(client, F.lit("")).alias("client_id"), topic.alias("topic"), qos.alias("qos")))


# Client codes of peer ids, by form.
CLIENTS = {"qB": "qBittorrent", "TR": "Transmission", "DE": "Deluge", "UT": "uTorrent", "lt": "libtorrent", "LT": "libtorrent", "AZ": "Azureus", "BT": "BitTorrent", "BI": "BiglyBT", "FD": "Free Download Manager", "KT": "KTorrent", "RB": "rtorrent", "WW": "WebTorrent", "FL": "Flud", "SD": "Xunlei", "TL": "Tribler"}
SHORT_CLIENTS = {"M": "Mainline", "S": "Shadow", "T": "BitTornado", "A": "ABC"}


def client_name(peer: Column) -> Column:
    """Name and dotted version of the client that a peer id (as text) names; NULL for other forms."""
    code, digits = F.substring(peer, 2, 2), F.regexp_replace(F.substring(peer, 4, 4), "[^A-Za-z0-9]", "")
    long = F.concat_ws(" ", F.coalesce(looked_up(code, CLIENTS), code), F.array_join(F.split(digits, "(?<=.)(?=.)"), "."))
    return F.when(peer.rlike(r"(?s)^-[\x00-\x7f]{2}.{4}-"), long).otherwise(looked_up(F.substring(peer, 1, 1), SHORT_CLIENTS))


def bittorrent(data: Column) -> Column:
    """The peer handshake: info hash, client and what the peer supports."""
    head = F.substring(data, 1, 20) == F.lit(b"\x13BitTorrent protocol")
    bit = lambda at, mask: F.coalesce(number(data, at, 1).bitwiseAND(mask) != 0, F.lit(False))
    whole = F.length(data) >= 28
    info = F.struct(F.when(F.length(data) >= 48, F.lower(F.hex(F.substring(data, 29, 20)))).alias("info_hash"), F.when(F.length(data) >= 68, client_name(F.decode(F.substring(data, 49, 20), "iso-8859-1"))).alias("client"), (whole & bit(27, 1)).alias("dht"), (whole & bit(25, 16)).alias("extension"), (whole & bit(27, 4)).alias("fast"))
    return F.when(head, info)


def bittorrent_udp(data: Column) -> Column:
    """A DHT message (its query's method, response or error) or a uTP header: kind and method."""
    text = F.decode(data, "iso-8859-1")
    kind = F.regexp_extract(text, r"(?s)^.*?1:y1:(.)", 1)
    asked = F.regexp_extract(text, r"(?s)^.*?1:q(\d{1,4}):", 1)
    n = F.when(asked != "", asked.cast("int"))
    begin = F.length(F.regexp_extract(text, r"(?s)^.*?1:q\d{1,4}:", 0)) + 1
    method = F.when(kind == "r", "response").when(kind == "e", "error").when((n <= 64) & (begin + n - 1 <= F.length(text)), F.substring(text, begin, n))
    dht = (F.length(data) >= 10) & text.startswith("d") & text.endswith("e") & kind.isin("q", "r", "e")
    first = number(data, 0, 1)
    utp = (F.length(data) >= 20) & (first.bitwiseAND(15) == 1) & (first < 0x50) & (number(data, 1, 1) <= 2) & (number(data, 2, 2) != 0) & ((F.floor(first / 16) == 3) | (number(data, 12, 4) != 0))
    return F.when(dht, F.struct(F.lit("DHT").alias("kind"), method.alias("method"))).when(utp, F.struct(F.lit("uTP").alias("kind"), F.lit(None).cast("string").alias("method")))


# SNMP versions and PDU tags, NetBIOS opcodes and message types.
SNMP_VERSIONS = {0: "v1", 1: "v2c", 3: "v3"}
SNMP_PDUS = {0xA0: "GET", 0xA1: "GETNEXT", 0xA2: "RESPONSE", 0xA3: "SET", 0xA4: "TRAP", 0xA5: "GETBULK", 0xA6: "INFORM", 0xA7: "TRAPv2", 0xA8: "REPORT"}
NETBIOS_OPCODES = {0: "Query", 5: "Register", 6: "Release", 7: "WACK", 8: "Refresh"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once. A few levels deep at most: the analyzer resolves one level a round."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _elements(data: Column, at: Column, steps: list[tuple[int, bool]]) -> Column:
    """The place behind a row of BER elements with given tags, going into those that are marked and past the others; NULL if one differs, has a length of unknown form, or ends beyond the data."""

    def step(at: Column, s: Column) -> Column:
        first = number(data, at + 1, 1)
        more = F.when(first < 128, 0).when(first.between(129, 132), first - 128).cast("int")  # bytes of a long length
        size = F.when(first < 128, first).otherwise(F.conv(F.hex(F.substring(data, (at + 3).cast("int"), more)), 16, 10).cast("long"))
        inside = at + 2 + more
        return F.when((number(data, at, 1) == s["tag"]) & (inside + size <= F.length(data)), F.when(s["enter"], inside).otherwise(inside + size))

    wanted = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(e).alias("enter")) for t, e in steps))
    return F.aggregate(wanted, at.cast("long"), step)


def snmp(data: Column) -> Column:
    """Version, community and PDU of an SNMP message, walked element by element; an encrypted v3 message shows no PDU."""
    tag = lambda at: number(data, at, 1)

    def named(b: Column) -> Column:
        """b: the places behind version, community, security parameters, and names of the scope."""
        version = looked_up(number(data, b["version"] - 1, 1), SNMP_VERSIONS)
        begin = _elements(data, b["version"], [(4, True)])
        community = F.substring(data, (begin + 1).cast("int"), (b["community"] - begin).cast("int")).cast("string")
        third = F.when(tag(b["secured"]) == 4, "ENCRYPTED").otherwise(looked_up(tag(b["scoped"]), SNMP_PDUS))
        pdu = F.when(version == "v3", third).otherwise(looked_up(tag(b["community"]), SNMP_PDUS))
        return F.struct(version.alias("version"), F.when((version != "v3") & F.is_valid_utf8(community), community).alias("community"), pdu.alias("pdu"))

    def scoped(b: Column) -> Column:
        return let(F.struct(b["version"].alias("version"), b["community"].alias("community"), b["secured"].alias("secured"), _elements(data, b["secured"], [(0x30, True), (4, False), (4, False)]).alias("scoped")), named)

    def begun(at: Column) -> Column:
        return let(F.struct(at.alias("version"), _elements(data, at, [(4, False)]).alias("community"), _elements(data, at, [(0x30, False), (4, False)]).alias("secured")), scoped)

    zero = F.lit(0)
    whole = let(F.when(F.length(data) >= 10, _elements(data, zero, [(0x30, True), (2, False)])), begun)
    return let(whole, lambda found: F.when(found["version"].isNotNull() & found["pdu"].isNotNull(), found))


def netbios_name(data: Column, at: int) -> Column:
    """A first-level encoded name: 32 letters, two a character; only what prints is kept."""
    letters = F.decode(F.substring(data, at + 2, 32), "iso-8859-1")
    plain = F.regexp_replace(F.decode(F.unhex(F.translate(letters, "ABCDEFGHIJKLMNOP", "0123456789ABCDEF")), "iso-8859-1"), "[^!-~]", "")
    return F.when((number(data, at, 1) == 32) & letters.rlike("^[A-P]{32}$"), F.nullif(plain, F.lit("")))


def netbios_names(data: Column) -> Column:
    """Name service: opcode, name, transaction, whether it answers, and its code. A WACK asks to wait and is no answer."""
    flags = number(data, 2, 2)
    code, answers = F.shiftright(flags, 11).bitwiseAND(15), flags >= 0x8000
    opcode = F.when(answers, F.when(code == 7, "WACK").otherwise("Response")).otherwise(F.coalesce(looked_up(code, NETBIOS_OPCODES), F.format_string("Unknown(%d)", code)))
    response = answers & (code != 7)
    return F.when(F.length(data) >= 12, F.struct(F.lit("NS").alias("service"), opcode.alias("opcode"), netbios_name(data, 12).alias("name"), number(data, 0, 2).alias("txid"), response.alias("is_response"), F.when(response, flags.bitwiseAND(15)).cast("int").alias("code")))


def netbios_datagrams(data: Column) -> Column:
    """Datagram service: message type, name, id, and whether it answers a query."""
    kind = number(data, 0, 1)
    opcode = F.when(kind.between(0x10, 0x12), "Datagram").when(kind == 0x13, "Error").when(kind == 0x14, "Query").when(kind.isin(0x15, 0x16), "Response").otherwise(F.format_string("Unknown(%d)", kind))
    name = F.when(kind.between(0x10, 0x12), netbios_name(data, 14)).when(kind.between(0x14, 0x16), netbios_name(data, 10))
    least = F.when(kind.between(0x10, 0x12), 14).when(kind == 0x13, 11).otherwise(10)
    return F.when(F.length(data) >= least, F.struct(F.lit("DGM").alias("service"), opcode.alias("opcode"), name.alias("name"), number(data, 2, 2).alias("txid"), kind.isin(0x15, 0x16).alias("is_response"), F.lit(None).cast("int").alias("code")))


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_TEXTS = T.ArrayType(T.StringType())
_DNS = _struct(("txid", T.LongType()), ("is_response", T.BooleanType()), ("rcode", T.IntegerType()), ("name", T.StringType()), ("qtype", T.IntegerType()), ("ips", _TEXTS), ("nodata", T.BooleanType()))


def _dns_name(raw: bytes, at: int) -> tuple[str, int]:
    labels, jumps, after = [], 0, None
    while raw[at]:
        if raw[at] >= 192:
            after, at, jumps = after or at + 2, (raw[at] & 63) << 8 | raw[at + 1], jumps + 1
            if jumps > 10:
                raise ValueError("loop")
            continue
        labels.append(raw[at + 1 : at + 1 + raw[at]].decode("ascii", "replace"))
        at += raw[at] + 1
    return ".".join(labels), after or at + 1


def _dns_one(raw: bytes, additional: bool = False) -> tuple:
    import ipaddress

    flags, questions, answers, authority, more = (int.from_bytes(raw[k : k + 2]) for k in (2, 4, 6, 8, 10))
    response, name, kind, ips, at = flags >> 15 == 1, None, None, [], 12
    if questions:
        name, at = _dns_name(raw, 12)
        kind, at = int.from_bytes(raw[at : at + 2]), at + 4
    # additional records stand behind those of the authority section, which are passed over
    sections = ((answers, True), *(((authority, False), (more, True)) if additional else ()))
    for read in [kept for n, kept in sections for _ in range(min(n, 64))] if response else ():
        if at >= len(raw) and ips:
            break
        _, at = _dns_name(raw, at)
        what, size = int.from_bytes(raw[at : at + 2]), int.from_bytes(raw[at + 8 : at + 10])
        if read and what in (1, 28) and len(ips) < 16:
            ips.append(str(ipaddress.ip_address(raw[at + 10 : at + 10 + size])))
        at += 10 + size
    rcode = flags & 15 if response else None
    return int.from_bytes(raw[:2]), response, rcode, name, kind, ips, (not ips and rcode == 0) if response and kind in (1, 28) else None


def _dns_frame(payload: pd.Series, additional: bool) -> pd.DataFrame:
    out = []
    for raw in payload:
        try:
            out.append(_dns_one(bytes(raw), additional) if raw is not None and len(raw) >= 12 else (None,) * 7)
        except (ValueError, IndexError):
            out.append((None,) * 7)
    return pd.DataFrame(out, columns=_DNS.names)


@F.pandas_udf(_DNS)
def dns(payload: pd.Series) -> pd.DataFrame:
    """The first question and the addresses of a DNS message; NULL fields if it is malformed."""
    return _dns_frame(payload, False)


@F.pandas_udf(_DNS)
def mdns(payload: pd.Series) -> pd.DataFrame:
    """As dns(), with the addresses of the additional records too."""
    return _dns_frame(payload, True)


_TLS = _struct(("record", T.StringType()), ("version", T.IntegerType()), ("sni", T.StringType()), ("alpn", _TEXTS), ("cipher", T.IntegerType()))


def _tls_one(raw: bytes) -> tuple:
    kind, version = raw[5], int.from_bytes(raw[9:11])
    at = 43 + 1 + raw[43]
    cipher = None
    if kind == 1:
        at += 2 + int.from_bytes(raw[at : at + 2])
        at += 1 + raw[at]
    else:
        cipher, at = int.from_bytes(raw[at : at + 2]), at + 3
    sni, alpn, stop = None, [], at + 2 + int.from_bytes(raw[at : at + 2])
    at += 2
    while at + 4 <= min(stop, len(raw)):
        what, size = int.from_bytes(raw[at : at + 2]), int.from_bytes(raw[at + 2 : at + 4])
        body = raw[at + 4 : at + 4 + size]
        if what == 0 and kind == 1 and len(body) > 5:
            sni = body[5 : 5 + int.from_bytes(body[3:5])].decode("ascii", "replace")
            sni += "[PARTIAL]" if len(sni) < int.from_bytes(body[3:5]) else ""
        elif what == 16:
            k = 2
            while k < len(body):
                alpn.append(body[k + 1 : k + 1 + body[k]].decode("ascii", "replace"))
                k += body[k] + 1
        elif what == 43:
            offered = body[1:] if kind == 1 else body
            version = max([v for v in (int.from_bytes(offered[k : k + 2]) for k in range(0, len(offered) - 1, 2)) if v <= 0x0304], default=version)
        at += 4 + size
    return "ClientHello" if kind == 1 else "ServerHello", version, sni, alpn, cipher


@F.pandas_udf(_TLS)
def tls(payload: pd.Series) -> pd.DataFrame:
    """Server name, ALPN, version and cipher of a TLS hello; NULL fields if it is none."""
    out = []
    for raw in payload:
        try:
            raw = bytes(raw)
            out.append(_tls_one(raw) if raw[0] == 22 and raw[5] in (1, 2) else (None,) * 5)
        except (IndexError, TypeError):
            out.append((None,) * 5)
    return pd.DataFrame(out, columns=_TLS.names).astype({"version": "Int32", "cipher": "Int32"})


_DHCP = _struct(("message", T.IntegerType()), ("hostname", T.StringType()), ("client_mac", T.StringType()))


@F.pandas_udf(_DHCP)
def dhcp(payload: pd.Series) -> pd.DataFrame:
    """Message type (required), host name and client address of a DHCP message."""
    out: list[tuple] = []
    for raw in payload:
        raw, kind, host = bytes(raw or b""), None, None
        if len(raw) >= 240 and raw[236:240] == b"\x63\x82\x53\x63":
            at = 240
            while at + 1 < len(raw) and raw[at] != 255:
                if raw[at]:
                    body = raw[at + 2 : at + 2 + raw[at + 1]]
                    kind = body[0] if raw[at] == 53 and body else kind
                    host = body.decode("utf-8", "replace") if raw[at] == 12 else host
                    at += 1 + raw[at + 1]
                at += 1
        out.append((kind, host if kind else None, ":".join(f"{b:02x}" for b in raw[28:34]) if kind else None))
    return pd.DataFrame(out, columns=["message", "hostname", "client_mac"]).astype({"message": "Int32"})


def sni_or_partial(name: Column, truncated: Column) -> Column:
    return F.when(truncated, F.concat(name, F.lit("[PARTIAL]"))).when(valid_hostname(name), name)


def register(spark: object) -> None:
    """Make the Arrow dissectors callable from SQL."""
    for name, f in (("dissect_dns", dns), ("dissect_mdns", mdns), ("dissect_tls", tls), ("dissect_dhcp", dhcp)):
        spark.udf.register(name, f)

