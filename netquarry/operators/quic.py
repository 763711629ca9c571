"""QUIC in column expressions: headers, Initial keys and decryption, CRYPTO frames, reassembly and connection ids.

A datagram's coalesced packets become rows. The Initial keys follow from the client's
connection id (HKDF over SHA-256); header protection is one AES block and the
payload AES-GCM, both by Spark's own functions, so nothing here leaves the JVM but the
TLS hello at the end. CRYPTO data is put together by connection, across packets and datagrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.net import looked_up
from netquarry.operators import decode
from netquarry.operators.decode import let, number
from netquarry.plans.packets import FLOW

# Versions, their names, and the salts of Initial keys (RFC 9001, RFC 9369 and the drafts).
V2 = 0x6B3343CF
VERSIONS = {1: "v1", V2: "v2", 0xFF00001D: "draft-29", 0xFF00001C: "draft-28", 0xFF00001B: "draft-27", 0x51303530: "Q050", 0x54303530: "T050", 0xFACEB001: "mvfst-22", 0xFACEB002: "mvfst-27"}
UNNAMED = (0x51303433, 0)
VERSION_NAMES = {f"{n:08X}": name for n, name in VERSIONS.items()}
SALT_V1 = "38762cf7f55934b34d179ae6a4c80cadccbb7f0a"
SALT_V2 = "0dede3def700a6db819381be6e269dcbf9bd2ed9"
SALT_29 = "afbfec289993d24c9e9786f19c6111e04390a899"
SALT_23 = "c3eef712c72ebb5a11a7d2432bb46365bef9f502"
KINDS = ["Initial", "0-RTT", "Handshake", "Retry"]
STATES = {"Initial": "Initial", "Retry": "Initial", "Version Negotiation": "Initial", "Handshake": "Handshaking", "0-RTT": "Handshaking", "1-RTT": "Connected"}
PRIORITY = {"Unknown": 0, "Initial": 1, "Handshaking": 2, "Connected": 3, "Draining": 4, "Closed": 5}
MOST_COALESCED, MOST_CRYPTO = 10, 1 << 16


def cut(data: Column, at: Column, n: Column | None = None) -> Column:
    """n bytes, or all, from a zero-based offset."""
    at = at.cast("int")
    return F.substring(data, at + 1, F.length(data) if n is None else n.cast("int"))


def wide(value: Column, size: int) -> Column:
    """A number as `size` bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def varint(data: Column, at: Column) -> Column:
    """(value, size) of a variable-length number; values of 2^30 or more are given as 2^30, NULL past the end."""

    def read(at: Column) -> Column:
        def rest(first: Column) -> Column:
            size = F.when(first < 64, 1).when(first < 128, 2).when(first < 192, 4).otherwise(8)
            value = F.when(first < 64, first).when(first < 128, number(data, at, 2).bitwiseAND(0x3FFF)).when(first < 192, number(data, at, 4).bitwiseAND(0x3FFFFFFF)).otherwise(number(data, at + 1, 7) + F.when(first > 192, 1 << 30).otherwise(0))
            return let(value, lambda v: F.when(v.isNotNull(), F.struct(F.least(v, F.lit(1 << 30)).alias("value"), size.alias("size"))))

        return let(number(data, at, 1), rest)

    return let(at, read)


def is_quic(data: Column) -> Column:
    """A known or plausible version behind a long header, or a short header of 20 bytes or more."""
    first, version = number(data, 0, 1), number(data, 1, 4)
    known = version.isin(*VERSIONS, *UNNAMED) | (F.shiftright(version, 8) == 0xFF0000) | (version.bitwiseAND(0x0F0F0F0F) == 0x0A0A0A0A)
    return F.coalesce((F.length(data) >= 5) & (((first >= 128) & known) | (first.between(64, 127) & (F.length(data) >= 20))), F.lit(False))


def brief(data: Column) -> Column:
    """Kind, version and destination id of a datagram's first packet, without its lengths; NULL if it is none."""
    first, version, n = number(data, 0, 1), number(data, 1, 4), number(data, 5, 1)
    code = F.shiftright(first, 4).bitwiseAND(3)
    kind = F.when(version == 0, "Version Negotiation").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (F.when(version == V2, (code + 3) % 4).otherwise(code) + 1).cast("int")))
    whole = n + 7 + number(data, n + 6, 1) <= F.length(data)
    long = F.struct(kind.alias("kind"), version.alias("version"), cut(data, F.lit(6), n).alias("dcid"))
    short = F.struct(F.lit("1-RTT").alias("kind"), F.lit(0).cast("long").alias("version"), cut(data, F.lit(1), F.lit(8)).alias("dcid"))
    return F.when(first >= 128, F.when(whole, long)).when(first >= 64, short)


_HEADER = "struct<kind:string,version:bigint,dcid:binary,number_at:bigint,size:bigint>"


def header(data: Column) -> Column:
    """The first packet of a datagram: kind, version, destination id, where its packet number stands (NULL if unknown) and its size; NULL if it is none. data is read many times: a column or a bound value."""
    first, version, size = number(data, 0, 1), number(data, 1, 4), F.length(data).cast("long")

    def long(b: Column) -> Column:
        """b: kind, version, length of the destination id, end of the ids."""
        bare = lambda number_at, end: F.struct(b["kind"], b["version"], cut(data, F.lit(6), b["n"]), number_at, end).cast(_HEADER)
        none = F.lit(None).cast("long")
        ended = lambda at: let(varint(data, at), lambda v: bare(at + v["size"], F.coalesce(F.least(at + v["size"] + v["value"], size), size)))
        token = let(varint(data, b["after"]), lambda t: let(b["after"] + t["size"] + t["value"], lambda at: F.when(at <= size, ended(at)).otherwise(bare(none, size))))
        return F.when(b["after"] <= size, F.when(b["kind"].isin("Retry", "Version Negotiation"), bare(none, size)).when(b["kind"] == "Initial", token).otherwise(ended(b["after"])))

    def begun(b: Column) -> Column:
        """b: first byte, version, length of the destination id."""
        code = F.shiftright(b["first"], 4).bitwiseAND(3)
        code = F.when(b["version"] == V2, (code + 3) % 4).otherwise(code)
        kind = F.when(b["version"] == 0, "Version Negotiation").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (code + 1).cast("int")))
        return let(F.struct(kind.alias("kind"), b["version"].alias("version"), b["n"].alias("n"), (b["n"] + 7 + number(data, b["n"] + 6, 1)).alias("after")), long)

    short = F.struct(F.lit("1-RTT"), F.lit(0), cut(data, F.lit(1), F.lit(8)), F.lit(None), size).cast(_HEADER)
    starts = F.struct(first.alias("first"), version.alias("version"), number(data, 5, 1).alias("n"))
    return F.when((first >= 128) & (size >= 6), let(starts, begun)).when(first.between(64, 127), short)


def coalesced(data: Column) -> Column:
    """The packets of a datagram, MOST_COALESCED at most, each with its bytes."""
    item = "struct<head:" + _HEADER + ",raw:binary>"
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{item}>").alias("found"))

    def step(seen: Column, _: Column) -> Column:
        end = F.struct(F.length(data).cast("long").alias("at"), seen["found"].alias("found"))
        add = lambda h, rest: F.struct((seen["at"] + h["size"]).alias("at"), F.concat(seen["found"], F.array(F.struct(h.alias("head"), cut(rest, F.lit(0), h["size"]).alias("raw")))).alias("found"))
        more = let(cut(data, seen["at"]), lambda rest: let(header(rest), lambda h: F.when(h.isNull(), end).otherwise(add(h, rest))))
        return F.when(seen["at"] >= F.length(data), seen).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_COALESCED)), empty, step)["found"]


# -- Initial keys ----------------------------------------------------------------


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _hmac_fixed(key: bytes, data: Column) -> Column:
    pad = lambda x: F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")))
    return _sha(F.concat(pad(0x5C), _sha(F.concat(pad(0x36), data))))


def _hmac(key: Column, data: bytes) -> Column:
    """HMAC-SHA-256 with a key of 32 bytes."""
    word = lambda x, k: F.lpad(F.hex(number(key, k, 4).bitwiseXOR(F.lit(int.from_bytes(bytes([x]) * 4)))), 8, "0")
    pad = lambda x: F.concat(F.unhex(F.array_join(F.transform(F.array(*map(F.lit, range(0, 32, 4))), lambda k: word(x, k)), "")), F.lit(bytes([x]) * 32))
    return _sha(F.concat(pad(0x5C), _sha(F.concat(pad(0x36), F.lit(data)))))


def _expand(secret: Column, label: str, size: int) -> Column:
    info = size.to_bytes(2) + bytes([6 + len(label)]) + b"tls13 " + label.encode() + b"\0\x01"
    return F.substring(_hmac(secret, info), 1, size)


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, here: a generator of one row keeps them from being put in place wherever they are read."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__s")
    return df.select("*", made).select(*(c for c in df.columns if c not in columns), "__s.*")


def with_keys(df: DataFrame, dcid: Column, version: Column, side: str = "client") -> DataFrame:
    """df with __key, __iv and __hp of a side's Initial packets; dcid may be NULL, and then they are."""
    salted = lambda salt: _hmac_fixed(bytes.fromhex(salt), dcid)
    first = F.when(version == V2, salted(SALT_V2)).when(version.between(0xFF00001D, 0xFF000020), salted(SALT_29)).when(version.between(0xFF000017, 0xFF00001C) | (version == 0xFACEB002), salted(SALT_23)).otherwise(salted(SALT_V1))
    secret = step(step(df, __secret=first), __secret=_expand(F.col("__secret"), f"{side} in", 32))
    one = lambda name, size: F.when(version == V2, _expand(F.col("__secret"), f"quicv2 {name}", size)).otherwise(_expand(F.col("__secret"), f"quic {name}", size))
    return step(secret, __key=one("key", 16), __iv=one("iv", 12), __hp=one("hp", 16)).drop("__secret")


def _mask(hp: Column, sample: Column) -> Column:
    return F.substring(F.aes_encrypt(sample, hp, F.lit("ECB"), F.lit("PKCS")), 1, 5)


def _nonce(iv: Column, packet_number: Column) -> Column:
    return F.concat(F.substring(iv, 1, 8), wide(number(iv, 8, 4).bitwiseXOR(packet_number.cast("long")), 4))


def opened(df: DataFrame, raw: Column, dcid: Column, version: Column, at: Column) -> DataFrame:
    """df with `plain`, the payload of a client Initial packet whose packet number stands at `at`; NULL if any input is, or where it does not authenticate."""
    able = (F.length(dcid) > 0) & (F.length(raw) >= at + 20)
    keyed = with_keys(df, F.when(able, dcid), version)
    masked = step(keyed, __mask=F.when(F.col("__hp").isNotNull(), _mask(F.col("__hp"), cut(raw, at + 4, F.lit(16)))))
    first = number(raw, 0, 1).bitwiseXOR(number(F.col("__mask"), 0, 1).bitwiseAND(15))
    shown = step(masked, __first=first, __size=first.bitwiseAND(3) + 1, __number=number(raw, at, 4).bitwiseXOR(number(F.col("__mask"), 1, 4)))
    size = F.col("__size")
    shown = step(shown, __number=F.floor(F.col("__number") / F.when(size == 1, 1 << 24).when(size == 2, 1 << 16).when(size == 3, 1 << 8).otherwise(1)))
    aad = F.concat(wide(F.col("__first"), 1), cut(raw, F.lit(1), at - 1), F.unhex(F.lpad(F.hex("__number"), (size * 2).cast("int"), F.lit("0"))))
    plain = F.try_aes_decrypt(F.concat(_nonce(F.col("__iv"), F.col("__number")), cut(raw, at + size)), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), aad)
    return step(shown, plain=F.when(F.col("__mask").isNotNull(), plain)).drop("__key", "__iv", "__hp", "__mask", "__first", "__size", "__number")


def protected(df: DataFrame, plain: Column, dcid: Column, version: int, packet_number: Column, side: str = "client") -> DataFrame:
    """df with `payload`, a protected Initial packet with a packet number of four bytes and no token; NULL for a NULL plain text."""
    first = 0xD3 if version == V2 else 0xC3
    head = F.concat(F.lit(bytes([first]) + version.to_bytes(4)), wide(F.length(dcid), 1), dcid, F.lit(b"\0\0"), wide((F.length(plain) + 20).bitwiseOR(F.lit(0x4000)), 2))
    keyed = step(with_keys(df, F.when(plain.isNotNull(), dcid), F.lit(version).cast("long"), side), __head=head, __number=packet_number.cast("long"))
    known = F.col("__key").isNotNull()
    sealed = F.aes_encrypt(plain, F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), _nonce(F.col("__iv"), F.col("__number")), F.concat("__head", wide(F.col("__number"), 4)))
    body = step(keyed, __body=F.when(known, cut(sealed, F.lit(12))))
    masked = step(body, __mask=F.when(known, _mask(F.col("__hp"), F.substring("__body", 1, 16))))
    mask = F.col("__mask")
    payload = F.concat(wide(F.lit(first).cast("long").bitwiseXOR(number(mask, 0, 1).bitwiseAND(15)), 1), cut(F.col("__head"), F.lit(1)), wide(F.col("__number").bitwiseXOR(number(mask, 1, 4)), 4), F.col("__body"))
    return step(masked, payload=payload).drop("__key", "__iv", "__hp", "__mask", "__head", "__number", "__body")


# -- frames ------------------------------------------------------------------------

_FRAMES = "struct<at:bigint,crypto:array<struct<offset:bigint,data:binary>>,close:bigint,error:bigint>"


def frames(plain: Column) -> Column:
    """The CRYPTO frames (offset, data) of a payload, and the type and error of a CONNECTION_CLOSE. A malformed or unexpected frame ends the walk."""
    return let(plain, _walked)


def _skipped(plain: Column, at: Column, n: Column) -> Column:
    """The place behind n variable-length numbers; NULL past the end."""
    return F.when(n <= F.length(plain), F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), at, lambda p, k: F.when(k <= n, p + varint(plain, p)["size"]).otherwise(p)))


def _walked(plain: Column) -> Column:
    size = F.length(plain).cast("long")

    def step(seen: Column, _: Column) -> Column:
        at = seen["at"]
        same = (seen["crypto"], seen["close"], seen["error"])
        to = lambda place, crypto=same[0], close=same[1], error=same[2]: F.struct(F.coalesce(place, size), crypto, close, error).cast(_FRAMES)
        pads = F.length(F.regexp_extract(F.hex(cut(plain, at)), "^(?:00)+", 0)) / 2
        acked = lambda kind: let(_skipped(plain, at + 1, F.lit(2).cast("long")), lambda p: let(varint(plain, p)["value"], lambda count: _skipped(plain, p, count * 2 + 2 + F.when(kind == 3, 3).otherwise(0))))
        piece = lambda o, n, begin: F.when(begin + n <= size, to(begin + n, F.concat(seen["crypto"], F.array(F.struct(o.alias("offset"), cut(plain, begin, n).alias("data"))))))
        crypto = let(varint(plain, at + 1), lambda o: let(varint(plain, at + 1 + o["size"]), lambda n: piece(o["value"], n["value"], at + 1 + o["size"] + n["size"])))
        closed = lambda kind: let(varint(plain, at + 1), lambda e: let(at + 1 + e["size"] + F.when(kind == 0x1C, varint(plain, at + 1 + e["size"])["size"]).otherwise(0), lambda r: let(varint(plain, r), lambda n: F.when(n.isNotNull(), to(r + n["size"] + n["value"], close=kind, error=e["value"])))))
        walked = lambda kind: F.when(kind == 0, to(at + pads)).when(kind == 1, to(at + 1)).when(kind.isin(2, 3), to(acked(kind))).when(kind == 6, crypto).when(kind.isin(0x1C, 0x1D), closed(kind))
        return F.when(at >= size, seen).otherwise(F.coalesce(let(number(plain, at, 1), walked), to(size)))

    start = F.struct(F.lit(0), F.array(), F.lit(None), F.lit(None)).cast(_FRAMES)
    return F.when(F.length(plain) > 0, F.aggregate(F.sequence(F.lit(1), F.length(plain)), start, step))


# -- packets and connections -------------------------------------------------------


def packets(datagrams: DataFrame) -> DataFrame:
    """One row a QUIC packet of the datagrams (FLOW, us, frame_no, payload): place, kind, version, dcid, state, crypto, and cid: the destination id of a client Initial that decrypts and holds CRYPTO data.

    Only UDP on port 443 with a plausible first packet is looked at; payloads that are none give no rows.
    """
    asked = (F.col("protocol") == "UDP") & ((F.col("local_port") == 443) | (F.col("remote_port") == 443)) & is_quic(F.col("payload"))
    rows = datagrams.where(asked).select(*FLOW, "us", "frame_no", F.posexplode(coalesced(F.col("payload"))).alias("place", "p"))
    h = F.col("p.head")
    clear = opened(rows, F.col("p.raw"), F.when(h["kind"] == "Initial", h["dcid"]), h["version"], h["number_at"])
    walked = step(clear, f=frames(F.col("plain")))
    close = F.when(F.col("f.close") == 0x1C, F.when(F.col("f.error") == 0, "Draining").otherwise("Closed")).when(F.col("f.close") == 0x1D, "Closed")
    by_kind = looked_up(h["kind"], STATES)
    crypto = F.when(F.size("f.crypto") > 0, F.col("f.crypto"))
    return walked.select(*FLOW, "us", "frame_no", "place", h["kind"].alias("kind"), h["version"].alias("version"), h["dcid"].alias("dcid"), F.coalesce(close, by_kind).alias("state"), close.isNotNull().alias("closes"), crypto.alias("crypto"), F.when(crypto.isNotNull(), h["dcid"]).alias("cid"))


def version_name(version: Column) -> Column:
    draft = F.when(F.shiftright(version, 8) == 0xFF0000, F.concat(F.lit("draft-"), version.bitwiseAND(0xFF).cast("string")))
    return F.coalesce(looked_up(F.lpad(F.hex(version), 8, "0"), VERSION_NAMES), draft)


def resolved(quic: DataFrame) -> DataFrame:
    """quic packets with the flow that their connection id was first seen on in place of their own: a migrated connection stays one. Packets without an id keep their flow."""
    order = F.struct("us", "frame_no", "place")
    known = quic.where("cid is not null").groupBy("cid").agg(F.min_by(F.struct(*FLOW), order).alias("__first"))
    joined = quic.join(known, "cid", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__first.{c}"), F.col(c)) for c in FLOW}).drop("__first")


def _record(hello: Column) -> Column:
    """A handshake message in a TLS record, for the TLS dissector."""
    return F.when(F.length(hello) > 42, F.concat(F.lit(b"\x16\x03\x01"), wide(F.length(hello), 2), hello))


def assembled(fragments: Column) -> Column:
    """The bytes from offset 0 on that (offset, data) fragments in order of arrival cover; one that overlaps an earlier one, or goes past MOST_CRYPTO bytes in all, is left out."""
    kept = "struct<size:bigint,parts:array<struct<offset:bigint,data:binary>>>"
    end = lambda f: f["offset"] + F.length(f["data"])

    def add(seen: Column, f: Column) -> Column:
        overlaps = F.exists(seen["parts"], lambda p: (f["offset"] < end(p)) & (end(f) > p["offset"]))
        fits = seen["size"] + F.length(f["data"]) <= MOST_CRYPTO
        return F.when(~overlaps & fits & (F.length(f["data"]) > 0), F.struct(seen["size"] + F.length(f["data"]), F.concat(seen["parts"], F.array(f))).cast(kept)).otherwise(seen)

    chosen = F.aggregate(fragments, F.struct(F.lit(0), F.array()).cast(kept), add)["parts"]
    run = F.aggregate(F.array_sort(chosen), F.lit(b""), lambda whole, p: F.when(p["offset"] == F.length(whole), F.concat(whole, p["data"])).otherwise(whole))
    return run


def salvaged(data: Column) -> Column:
    """A server name found by its extension's form in a fragment alone: type 0, and three lengths that agree; marked when it is cut off."""
    text = F.decode(data, "iso-8859-1")
    code = lambda s: F.ascii(s).cast("int")
    found = F.regexp_extract_all(text, F.lit(r"(?s)\x00\x00..(?:.)(?:.)\x00..[A-Za-z0-9._-]+"), F.lit(0))

    def named(m: Column) -> Column:
        two = lambda k: code(F.substring(m, k, 1)) * 256 + code(F.substring(m, k + 1, 1))
        name = F.substring(m, F.lit(10), two(8))
        return F.when((two(3) == two(5) + 2) & (two(5) == two(8) + 3), F.when(F.length(name) == two(8), name).when(text.endswith(name), F.concat(name, F.lit("[PARTIAL]"))))

    return F.try_element_at(F.filter(F.transform(found, named), lambda x: x.isNotNull()), F.lit(1))


def flows(datagrams: DataFrame) -> DataFrame:
    """QUIC by connection: state (the highest seen; a close stands), the last packet type, the first id and version, server name and ALPN of the hello put together from all CRYPTO frames.

    A connection whose hello is not whole keeps a name that one fragment shows. Of fragments of
    one offset the first counts, so a connection holds 2^16 of them at most.
    """
    seen = resolved(packets(datagrams))
    order = F.struct("us", "frame_no", "place")
    rank = looked_up(F.col("state"), PRIORITY)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    named = seen.withColumn("version_name", version_name(F.col("version"))).withColumn("id", F.when(F.length("dcid") > 0, F.col("dcid")))
    sums = named.groupBy(*FLOW).agg(F.coalesce(F.max_by("state", F.when(F.col("closes"), order)), F.max_by("state", rank)).alias("state"), F.max_by("kind", order).alias("kind"), first("id").alias("dcid"), first("version_name").alias("version"), F.count(F.lit(1)).alias("quic_packets"))
    parts = seen.where("crypto is not null").select(*FLOW, "us", "frame_no", "place", F.posexplode("crypto").alias("turn", "c"))
    once = parts.where(F.col("c.offset") < MOST_CRYPTO).groupBy(*FLOW, F.col("c.offset").alias("offset")).agg(F.min(F.struct("us", "frame_no", "place", "turn", F.struct("c.offset", "c.data").alias("c"))).alias("p"))
    lists = once.groupBy(*FLOW).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["c"]).alias("parts"))
    whole = step(lists, hello=assembled(F.col("parts")))
    names = F.filter(F.transform("parts", lambda p: salvaged(p["data"])), lambda x: x.isNotNull())
    shown = whole.withColumn("__tls", decode.tls(_record(F.col("hello"))))
    sni = F.coalesce(F.when(~F.col("__tls.sni").endswith("[PARTIAL]"), F.col("__tls.sni")), F.try_element_at(F.filter(names, lambda x: ~x.endswith("[PARTIAL]")), F.lit(1)), F.col("__tls.sni"), F.try_element_at(names, F.lit(1)))
    tls = shown.select(*FLOW, sni.alias("sni"), F.col("__tls.alpn").alias("alpn"))
    return sums.join(tls, FLOW, "left")
