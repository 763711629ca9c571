"""The keyword filter: tokens become one native predicate, pushed down with the rest of the plan.

Tokens are separated by white space and joined by AND. `key:value` searches one
field, anything else all of them. /pattern/ is a regular expression, digits for a
port mean that port, other values are found anywhere in the field, in any case.
An absent field never matches.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.net import endpoint

PORTS = {"port": ["local_port", "remote_port"]} | dict.fromkeys(["sport", "srcport", "source-port"], ["local_port"]) | dict.fromkeys(["dport", "dstport", "dest-port", "destination-port"], ["remote_port"])
TEXTS = (
    dict.fromkeys(["src", "source"], ["local_ip"])
    | dict.fromkeys(["dst", "dest", "destination"], ["remote_ip"])
    | dict.fromkeys(["proto", "protocol"], ["protocol"])
    | dict.fromkeys(["process", "proc"], ["process_name"])
    | dict.fromkeys(["service", "svc"], ["service_name"])
    | dict.fromkeys(["sni", "host", "hostname"], ["sni", "host", "attributed_hostname"])
    | dict.fromkeys(["app", "application"], ["application"])
    | {"state": ["state"], "pod": ["pod_name", "pod_uid"]}
    | dict.fromkeys(["ns", "namespace"], ["pod_namespace"])
    | dict.fromkeys(["container", "cont"], ["container_name", "container_id"])
)
#: What a token without a key searches, besides both endpoints.
GENERAL = ["protocol", "process_name", "service_name", "sni", "host", "application", "attributed_hostname", "dns_query", "user_agent", "path", "sender_vendor", "target_vendor", "alpn", "dpi_method", "dpi_query", "dpi_software", "dpi_command", "dpi_args", "dpi_username", "dpi_system", "dpi_hostname", "dpi_target", "dpi_client_id", "dpi_topic", "dpi_client", "dpi_code", "dpi_community", "dpi_netbios_name"]


def _pattern(value: str) -> str | None:
    """The expression inside slashes, if it is one that both dialects read alike."""
    if len(value) > 2 and value.startswith("/") and value.endswith("/"):
        inner = value[1:-1]
        if re.search(r"\(\?[=!<]|\\[1-9]", inner):
            return None
        try:
            re.compile(inner)
        except re.error:
            return None
        return inner
    return None


def text_match(field: Column, value: str) -> Column:
    inner = _pattern(value)
    return F.coalesce(field.rlike(f"(?i){inner}") if inner else F.lower(field).contains(value), F.lit(False))


def port_match(port: Column, value: str) -> Column:
    inner = _pattern(value)
    if inner:
        return port.cast("string").rlike(inner)
    if re.fullmatch("[0-9]+", value) and int(value) < 65536:
        return port == int(value)
    return port.cast("string").contains(value)


def parse(query: str, columns: list[str]) -> Column:
    """The predicate of a query over a table that has `columns`; a blank query matches all."""
    out = F.lit(True)
    either = lambda parts: functools.reduce(lambda a, b: a | b, parts, F.lit(False))
    for token in query.split():
        key, colon, value = token.partition(":")
        key, value = key.lower(), value.lower()
        if colon and key in PORTS:
            found = [port_match(F.col(c), value) for c in PORTS[key]]
        elif colon and key in TEXTS:
            found = [text_match(F.col(c), value) for c in TEXTS[key] if c in columns]
        else:
            ends = [text_match(endpoint(F.col(f"{s}_ip"), F.col(f"{s}_port")), token.lower()) for s in ("local", "remote")]
            found = ends + [text_match(F.col(c), token.lower()) for c in GENERAL if c in columns]
        out = out & either(found)
    return out


def not_localhost() -> Column:
    loop = lambda c: F.col(c).startswith("127.") | (F.col(c) == "::1")
    return ~(loop("local_ip") & loop("remote_ip"))


def not_ptr_lookup(resolving: bool) -> Column:
    return ~F.coalesce((F.col("application") == "DNS") & (F.col("dns_type") == "PTR"), F.lit(False)) if resolving else F.lit(True)


def live_or_all(show_historic: bool) -> Column:
    return F.lit(True) if show_historic else ~F.coalesce(F.col("is_historic"), F.lit(False))
