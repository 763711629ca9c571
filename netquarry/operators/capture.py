"""Capture filters: a small part of the usual filter language as a condition on decoded packets.

Forms: tcp, udp, icmp, igmp, arp, ip, ip6; [src|dst] host A, net A/n, port P, portrange P-Q, each behind a
protocol if wanted; less N, greater N; not, and, or (also !, &&, ||) and parentheses. As in the
language itself, `and` and `or` bind alike, from left to right, and a bare value repeats the words before it
("port 80 or 443"). Anything else is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.operators.joins import address_digits, block_digits

PROTOCOLS = {"tcp": "TCP", "udp": "UDP", "icmp": "ICMP", "icmp6": "ICMP", "igmp": "IGMP", "arp": "ARP"}
KINDS = ("host", "net", "port", "portrange")
WORDS = {*PROTOCOLS, *KINDS, "ip", "ip6", "src", "dst", "less", "greater", "not", "and", "or", "(", ")"}


def _side(name: str) -> tuple[Column, Column]:
    """Address and port of a packet's source or destination."""
    own, other = ("local", "remote") if name == "src" else ("remote", "local")
    pick = lambda c: F.when(F.col("is_outgoing"), F.col(f"{own}_{c}")).otherwise(F.col(f"{other}_{c}"))
    return pick("ip"), pick("port")


def _protocol(name: str) -> Column:
    if name in ("ip", "ip6"):
        six = F.col("local_ip").contains(":")
        return (six if name == "ip6" else ~six) & (F.col("protocol") != "ARP")
    family = {"icmp": ~F.col("local_ip").contains(":"), "icmp6": F.col("local_ip").contains(":")}.get(name)
    return (F.col("protocol") == PROTOCOLS[name]) & (F.lit(True) if family is None else family)


def _matches(kind: str, value: str, side: str) -> Column:
    ip, port = _side(side)
    if kind in ("port", "portrange"):
        low, _, high = value.partition("-")
        if not low.isdigit() or (high or low).isdigit() is False or bool(high) != (kind == "portrange"):
            raise ValueError(f"{value!r} is no {kind}")
        return F.col("protocol").isin("TCP", "UDP") & port.between(int(low), int(high or low))
    address, _, length = value.partition("/")
    if not re.fullmatch(r"[0-9A-Fa-f:.]+", address) or (length and not length.isdigit()):
        raise ValueError(f"{value!r} is no address")
    whole = 128 if ":" in address else 32
    bits = int(length) if length else whole
    if bits > whole or (kind == "host" and length):
        raise ValueError(f"{value!r} is no {kind}")
    digits = address_digits(ip)
    return (F.length(digits) == whole // 4) & (block_digits(digits, F.lit(bits)) == block_digits(address_digits(F.lit(address)), F.lit(bits)))


def compiled(text: str) -> Column:
    """The condition of a filter; all packets for an empty one. Where a column that it reads is null the packet does not match."""
    tokens = re.findall(r"&&|\|\||!|\(|\)|[^\s()!&|]+", text.lower())
    tokens = [{"&&": "and", "||": "or", "!": "not"}.get(t, t) for t in tokens]
    at, last = 0, None

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"{text!r} ends too early")
        at += 1
        return tokens[at - 1]

    def primitive() -> Column:
        nonlocal last
        if peek() in ("less", "greater"):
            more, value = take() == "greater", take()
            if not value.isdigit():
                raise ValueError(f"{value!r} is no length")
            return F.col("packet_len") >= int(value) if more else F.col("packet_len") <= int(value)
        given = peek() in WORDS
        protocol = take() if peek() in (*PROTOCOLS, "ip", "ip6") else None
        side = take() if peek() in ("src", "dst") else None
        kind = take() if peek() in KINDS else None
        if protocol and not side and not kind:
            return _protocol(protocol)
        if not given:
            if last is None:
                raise ValueError(f"{peek()!r} stands without what it is")
            protocol, side, kind = last
        value = take()
        if value in WORDS:
            raise ValueError(f"{value!r} stands where a value should")
        kind = kind or ("net" if "/" in value else "host")
        last = (protocol, side, kind)
        sides = [_matches(kind, value, s) for s in ([side] if side else ["src", "dst"])]
        found = sides[0] if side else sides[0] | sides[1]
        return found & _protocol(protocol) if protocol else found

    def factor() -> Column:
        if peek() == "not":
            take()
            return ~factor()
        if peek() == "(":
            take()
            inner = expression()
            if take() != ")":
                raise ValueError(f"{text!r} lacks a parenthesis")
            return inner
        return F.coalesce(primitive(), F.lit(False))

    def expression() -> Column:
        found = factor()
        while peek() in ("and", "or"):
            found = found & factor() if take() == "and" else found | factor()
        return found

    if not tokens:
        return F.lit(True)
    found = expression()
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} stands behind the end of {text!r}")
    return found
