"""Scalar functions on addresses, names, sizes and rates, all as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coded(key: Column, names: dict, other: Column | None = None) -> Column:
    """names[key], else `other`."""
    out = None
    for k, v in names.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out if other is None else out.otherwise(other)


def looked_up(key: Column, names: dict) -> Column:
    """names[key] or NULL, with key written once: for keys that are long expressions."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


# -- addresses ----------------------------------------------------------------


def octet(ip: Column, k: int) -> Column:
    return F.split_part(ip, F.lit("."), F.lit(k + 1)).cast("long")


def ip4_number(ip: Column) -> Column:
    """A dotted IPv4 address as a long; NULL for anything else."""
    plain = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(plain, F.shiftleft(octet(ip, 0), 24) + F.shiftleft(octet(ip, 1), 16) + F.shiftleft(octet(ip, 2), 8) + octet(ip, 3))


def ip6_hex(ip: Column) -> Column:
    """A textual IPv6 address as 32 hex digits."""
    low = F.lower(ip)
    halves = F.split(low, "::", 2)
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.element_at(halves, -1))).otherwise(F.array().cast("array<string>"))
    pad = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, pad, right), lambda g: F.lpad(g, 4, "0")), "")


def ip_sort_key(ip: Column) -> Column:
    """(family, 32 hex digits): IPv4 before IPv6, then by number."""
    six = ip.contains(":")
    return F.struct(F.when(six, 6).otherwise(4).alias("family"), F.when(six, ip6_hex(ip)).otherwise(F.lpad(F.lower(F.hex(ip4_number(ip))), 32, "0")).alias("number"))


def endpoint(ip: Column, port: Column) -> Column:
    """ip:port, an IPv6 address in brackets."""
    return F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]:"), port.cast("string"))).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def scope(ip: Column) -> Column:
    """What an address is reserved for: tests in order, first match wins."""
    a, b, c = (octet(ip, k) for k in range(3))
    h = ip6_hex(ip)
    first = F.conv(F.substring(h, 1, 4), 16, 10).cast("long")
    four = (
        F.when(ip == "0.0.0.0", "UNSPECIFIED")
        .when(a == 127, "LOOPBACK")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "PRIVATE")
        .when((a == 169) & (b == 254), "LINK-LOCAL")
        .when((a == 100) & b.between(64, 127), "CGNAT")
        .when(((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)), "DOCUMENTATION")
        .when((a == 198) & b.isin(18, 19), "BENCHMARKING")
        .when(ip == "255.255.255.255", "BROADCAST")
        .when(a.between(224, 239), "MULTICAST")
        .when(a >= 240, "RESERVED")
        .otherwise("PUBLIC")
    )
    six = (
        F.when(h == "0" * 32, "UNSPECIFIED")
        .when(h == "0" * 31 + "1", "LOOPBACK")
        .when(h.startswith("0" * 20 + "ffff"), "IPV4-MAPPED")
        .when(h.startswith("0100" + "0" * 12), "DISCARD")
        .when(h.startswith("20010db8"), "DOCUMENTATION")
        .when(h.startswith("ff"), "MULTICAST")
        .when(first.bitwiseAND(0xFFC0) == 0xFE80, "LINK-LOCAL")
        .when(first.bitwiseAND(0xFE00) == 0xFC00, "UNIQUE-LOCAL")
        .otherwise("PUBLIC")
    )
    return F.when(ip.contains(":"), six).otherwise(four)


def address_kind(ip: Column, subnet_broadcast: Column) -> Column:
    """Multicast, Broadcast (limited or of a subnet, as flagged) or Unicast."""
    return F.when(scope(ip) == "MULTICAST", "Multicast").when((ip == "255.255.255.255") | F.coalesce(subnet_broadcast, F.lit(False)), "Broadcast").otherwise("Unicast")


def broadcast_of(ip: Column, prefix: Column) -> Column:
    """The broadcast address number of a subnet; none for /31 and /32."""
    return F.when(prefix < 31, ip4_number(ip).bitwiseOR(F.call_function("shiftright", F.lit(4294967295), prefix)))


def ip4_text(number: Column) -> Column:
    return F.concat_ws(".", *((F.shiftright(number, s) % 256).cast("string") for s in (24, 16, 8, 0)))


def hex_le_ip4(digits: Column) -> Column:
    """Eight hex digits in little-endian order, as kernels print them, to dotted form."""
    return F.concat_ws(".", *(F.conv(F.substring(digits, at, 2), 16, 10) for at in (7, 5, 3, 1)))


def mac_text(raw: Column) -> Column:
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11), F.lit(2)), lambda k: F.substring(F.hex(raw), k, F.lit(2))), ":"))


def mac_prefix(mac: Column) -> Column:
    """Six hex digits of a MAC in any of the usual spellings."""
    return F.substring(F.lower(F.regexp_replace(mac, "[:-]", "")), 1, 6)


def mac_first(mac: Column) -> Column:
    return F.conv(F.substring(mac_prefix(mac), 1, 2), 16, 10).cast("int")


def mac_is_local(mac: Column) -> Column:
    return mac_first(mac).bitwiseAND(2) == 2


def mac_is_unicast(mac: Column) -> Column:
    return (mac_first(mac).bitwiseAND(1) == 0) & ~F.regexp_replace(mac, "[:-]", "").rlike("^0+$")


# -- names --------------------------------------------------------------------

# Fixed values.
TCP_STATES = ["SYN_SENT", "SYN_RECV", "ESTABLISHED", "FIN_WAIT1", "FIN_WAIT2", "CLOSE_WAIT", "LAST_ACK", "TIME_WAIT", "CLOSING", "CLOSED", "TCP_UNKNOWN"]
ICMP_NAMES = {0: "Echo Reply", 3: "Destination Unreachable", 5: "Redirect", 8: "Echo Request", 11: "Time Exceeded"}
ICMP6_NAMES = {128: "Echo Request", 129: "Echo Reply", 133: "Router Solicitation", 134: "Router Advertisement", 135: "Neighbor Solicitation", 136: "Neighbor Advertisement", 137: "Redirect"}
IGMP_NAMES = {0x11: "Membership Query", 0x12: "Membership Report v1", 0x16: "Membership Report v2", 0x22: "Membership Report v3", 0x17: "Leave Group"}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
DNS_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 24: "SIG", 25: "KEY",
    28: "AAAA", 29: "LOC", 33: "SRV", 35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME", 42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY",
    46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 55: "HIP", 59: "CDS",
    60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB", 65: "HTTPS", 108: "EUI48", 109: "EUI64", 249: "TKEY",
    250: "TSIG", 256: "URI", 257: "CAA", 32768: "TA", 32769: "DLV",
}
MATCH_LABELS = {"exact-tuple": "exact tuple", "wildcard-local-address": "wildcard local address", "listener-socket": "listener socket", "procfs-exact": "procfs exact", "procfs-relaxed": "procfs relaxed", "unspecified": "unspecified"}
QUIC_VERSIONS = {1: "v1", 0x6B3343CF: "v2", 0x51303530: "Q050", 0x54303530: "T050", 0xFACEB001: "mvfst-22", 0xFACEB002: "mvfst-27"}
CIPHERS = {0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256", 0x1304: "TLS_AES_128_CCM_SHA256", 0x1305: "TLS_AES_128_CCM_8_SHA256", 0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384", 0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", 0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256", 0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256", 0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384", 0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA"}
SECURE_CIPHERS = [0x1301, 0x1302, 0x1303, 0x1304, 0x1305, 0xC02B, 0xC02C, 0xC02F, 0xC030, 0xCCA8, 0xCCA9, 0xCCAA, 0x009E, 0x009F]


def icmp_name(kind: Column, six: Column) -> Column:
    other = F.concat(F.lit("Type "), kind.cast("string"))
    return F.when(six, coded(kind, ICMP6_NAMES, other)).otherwise(coded(kind, ICMP_NAMES, other))


def igmp_name(kind: Column) -> Column:
    return coded(kind, IGMP_NAMES, F.format_string("Type 0x%02x", kind))


def dns_type(code: Column) -> Column:
    return coded(code, DNS_TYPES, F.concat(F.lit("TYPE"), code.cast("string")))


def dns_rcode(code: Column) -> Column:
    return coded(code, DNS_RCODES, F.concat(F.lit("RCODE "), code.cast("string")))


def quic_version(code: Column) -> Column:
    draft = (code >= 0xFF000000) & (code <= 0xFF0000FF)
    return F.when(draft, F.concat(F.lit("draft-"), (code % 256).cast("string"))).otherwise(coded(code, QUIC_VERSIONS))


def cipher_name(code: Column) -> Column:
    return coded(code, CIPHERS)


def cipher_text(code: Column) -> Column:
    digits = F.format_string("0x%04X", code)
    return F.coalesce(F.concat(cipher_name(code), F.lit(" ("), digits, F.lit(")")), digits)


def cipher_is_secure(code: Column) -> Column:
    return code.isin(SECURE_CIPHERS)


def match_is_exact(token: Column) -> Column:
    return token.isin("exact-tuple", "procfs-exact")


# -- numbers and texts --------------------------------------------------------


def seq_lt(a: Column, b: Column) -> Column:
    """a before b among 32-bit sequence numbers."""
    return F.pmod(a - b, F.lit(4294967296)) >= 2147483648


def per_second(delta: Column, seconds: Column, scale: float = 1.0) -> Column:
    """Rounded rate; 0 for less than a quarter second."""
    return F.when(seconds < 0.25, F.lit(0)).otherwise(F.round(delta * scale / seconds).cast("long"))


def percentage(part: Column, total: Column) -> Column:
    """part of total in percent, within 0 and 100; 0 of nothing."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), part / total * 100))).otherwise(0.0)


def coverage(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), part / total))


def smooth(raw: Column, before: Column) -> Column:
    """A displayed rate: rises at once, falls gently, goes to zero fast."""
    s = F.when(raw >= before, raw).when(raw == 0, before * 0.15).otherwise(0.6 * raw + 0.4 * before)
    return F.when(s < 1.0, 0.0).otherwise(s)


def fixed(x: Column, digits: int) -> Column:
    """x with so many digits after the point, 2 at most; of its exact binary value, ties to even. format_string rounds the shortest decimal instead, ties up."""
    if not digits:
        return F.rint(x).cast("long").cast("string")
    unit = 10**digits
    bits = 63 - unit.bit_length()  # those of the fraction that still fit a long once multiplied; two digits are exact from 1/16 on
    whole = F.floor(x)
    part = ((x - whole) * float(1 << bits)).cast("long") * unit
    below, rest, half = F.shiftright(part, bits), part.bitwiseAND((1 << bits) - 1), 1 << (bits - 1)
    digits_ = below + F.when((rest > half) | ((rest == half) & (below % 2 == 1)), 1).otherwise(0)  # unit itself is a carry
    text = F.concat((whole + F.when(digits_ == unit, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((digits_ % unit).cast("string"), digits, "0"))
    return F.when(x.between(0.0, 2.0**53), text).otherwise(F.format_string(f"%.{digits}f", x))


def _scaled(x: Column, steps: list[tuple[float, int, str]], small: Column) -> Column:
    out = None
    for least, digits, unit in steps:
        text = F.concat(fixed(x / least, digits), F.lit(unit))
        out = F.when(x >= least, text) if out is None else out.when(x >= least, text)
    return out.otherwise(small)


_GB, _MB, _KB = 1024.0**3, 1024.0**2, 1024.0


def format_rate(x: Column) -> Column:
    x = x.cast("double")
    return _scaled(x, [(_GB, 2, " GB/s"), (_MB, 2, " MB/s"), (_KB, 2, " KB/s")], F.when(x > 0, F.concat(fixed(x, 0), F.lit(" B/s"))).otherwise("-"))


def format_rate_compact(x: Column, zero: str = "-") -> Column:
    x = x.cast("double")
    return _scaled(x, [(_GB, 1, "G"), (_MB, 1, "M"), (_KB, 0, "K")], F.when(x > 0, F.concat(fixed(x, 0), F.lit("B"))).otherwise(zero))


def format_bytes(x: Column) -> Column:
    return _scaled(x.cast("double"), [(_GB, 2, " GB"), (_MB, 2, " MB"), (_KB, 2, " KB")], F.concat(x.cast("long").cast("string"), F.lit(" B")))


def format_rtt(us: Column) -> Column:
    ms = us / 1000.0
    return F.when(ms < 10, F.concat(fixed(ms, 1), F.lit("ms"))).when(ms < 1000, F.concat(fixed(ms, 0), F.lit("ms"))).otherwise(F.concat(fixed(ms / 1000, 1), F.lit("s")))


def truncate(s: Column, width: int) -> Column:
    return F.when(F.length(s) <= width, s).otherwise(F.concat(F.substring(s, 1, width - 1), F.lit("…")) if width > 1 else F.lit("…"))


def ellipsize_left(s: Column, width: int) -> Column:
    return F.when(F.length(s) <= width, s).otherwise(F.concat(F.lit("…"), F.right(s, F.lit(width - 1))) if width > 1 else F.lit("…"))


def process_label(name: Column, pid: Column) -> Column:
    return F.when(pid.isNotNull(), F.concat(F.coalesce(name, F.lit("Unknown")), F.lit(" ("), pid.cast("string"), F.lit(")"))).otherwise(F.coalesce(name, F.lit("Unknown")))


def endpoint_label(kind: Column, ip: Column, port: Column, gateway: Column) -> Column:
    named = F.when(kind == "Broadcast", F.concat(F.lit("bcast:"), port.cast("string"))).when(kind == "Multicast", F.concat(F.lit("mcast:"), port.cast("string"))).otherwise(endpoint(ip, port))
    return F.when(F.coalesce(gateway, F.lit(False)), F.concat(named, F.lit(" (gw)"))).otherwise(named)


def rtt_class(ms: Column) -> Column:
    return F.when(ms < 50, "good").when(ms < 150, "fair").otherwise("poor")


def loss_class(pct: Column) -> Column:
    return F.when(pct < 1, "good").when(pct < 5, "fair").otherwise("poor")


def staleness(idle: Column, timeout: Column) -> Column:
    ratio = idle / timeout
    return F.when(ratio >= 0.90, "critical").when(ratio >= 0.75, "warn").otherwise("fresh")


def comment_value(s: Column) -> Column:
    """A value for a space-delimited comment: control characters and blanks become _, outer _ go; NULL if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(s, r"[\p{Cntrl}\s]", "_"), F.lit("_")), F.lit(""))


def current_rtt(srtt: Column, initial: Column, icmp: Column) -> Column:
    return F.coalesce(srtt, initial, icmp)


def rtt_ms(us: Column) -> Column:
    return F.round(us / 100.0) / 10.0


def age_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))


HOSTNAME = r"^(?=.{4,253}$)(?=.*[A-Za-z])[A-Za-z0-9_-]{1,63}(\.[A-Za-z0-9_-]{1,63})+$"


def valid_hostname(host: Column) -> Column:
    """4 to 253 characters, a dot, labels of 1 to 63 allowed characters, a letter somewhere."""
    return F.coalesce(host.rlike(HOSTNAME), F.lit(False))


def authoritative_hostname(host: Column) -> Column:
    return F.when(~host.endswith("[PARTIAL]"), host)


# Link types by number.
LINK_CLASSES = {1: "Ethernet", 0: "RawIP", 12: "RawIP", 101: "RawIP", 228: "RawIP", 229: "RawIP", 113: "LinuxSLL", 276: "LinuxSLL2", 149: "Pktap", 258: "Pktap"}


def link_class(linktype: Column, interface: Column) -> Column:
    """What a link's frames begin with; tunnels are told by the interface's name."""
    name = F.coalesce(interface, F.lit(""))
    return F.when(name.startswith("tun") | name.startswith("utun"), "Tun").when(name.startswith("tap"), "Tap").otherwise(coded(linktype, LINK_CLASSES, F.lit("Unknown")))


def process_tree(ancestors: Column, name: Column, pid: Column) -> Column:
    """Ancestors, oldest first, and the process itself, joined by arrows."""
    one = lambda n, p: F.concat(n, F.lit(" ("), p.cast("string"), F.lit(")"))
    return F.array_join(F.concat(F.transform(ancestors, lambda a: one(a["name"], a["pid"])), F.array(one(name, pid))), " → ")


def owner_label(name: Column, number: Column) -> Column:
    """A user's or group's name with its number, or the number alone."""
    return F.coalesce(F.concat(name, F.lit(" ("), number.cast("string"), F.lit(")")), number.cast("string"))
