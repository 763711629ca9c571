"""Event lines, sidecar lines, packet comments and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.net import comment_value, endpoint


#: Columns that go into lines under their own names where a table has them.
OPTIONAL = ["timestamp", "destination_hostname", "source_hostname", "pid", "service_name", "dpi_protocol", "dpi_domain", "geoip_country_code", "geoip_country_name", "geoip_asn", "geoip_as_org", "geoip_city", "geoip_postal_code", "attribution_match", "kubernetes", "process_gid", "process_lineage", "rtt_ms", "process_ppid", "process_executable", "process_uid"]


def _line(fields: dict[str, Column], explicit: tuple[str, ...] = ()) -> Column:
    """A JSON object with keys in alphabetical order; absent values are left out, but for the explicit ones, which are null."""

    def part(name: str) -> Column:
        inner = F.to_json(F.array(fields[name]), {"ignoreNullFields": "false"})
        value = F.concat(F.lit(f'"{name}":'), F.substring(inner, F.lit(2), F.length(inner) - 2))
        return value if name in explicit else F.when(fields[name].isNotNull(), value)

    return F.concat(F.lit("{"), F.concat_ws(",", *(part(n) for n in sorted(fields))), F.lit("}"))


def _kinds(rows: DataFrame, local: str, remote: str, gateway: str) -> dict[str, Column]:
    """Address kinds other than Unicast, and whether the remote end is a gateway, under the names of a kind of line."""
    given = {local: "local_addr_kind", remote: "remote_addr_kind"}
    out = {k: F.when(F.col(c) != "Unicast", F.lower(c)) for k, c in given.items() if c in rows.columns}
    return out | ({gateway: F.when(F.col("remote_is_gateway"), True)} if "remote_is_gateway" in rows.columns else {})


def event_lines(rows: DataFrame) -> DataFrame:
    """JSON lines with keys in alphabetical order and absent ones left out; byte counts and seconds for closed connections only."""
    closed = F.col("event") == "connection_closed"
    fields = {
        "bytes_received": F.when(closed, F.col("bytes_received")),
        "bytes_sent": F.when(closed, F.col("bytes_sent")),
        "destination_ip": F.col("remote_ip"),
        "destination_port": F.col("remote_port"),
        "duration_secs": F.when(closed, F.expr("(last_us - created_us) div 1000000")),
        "event": F.col("event"),
        "process_name": F.col("process_name"),
        "protocol": F.col("protocol"),
        "source_ip": F.col("local_ip"),
        "source_port": F.col("local_port"),
    }
    fields |= {c: F.col(c) for c in OPTIONAL if c in rows.columns} | _kinds(rows, "source_addr_kind", "destination_addr_kind", "destination_is_gateway")
    if "connection_direction" in rows.columns:
        fields["direction"] = F.when(F.col("connection_direction"), "outgoing").when(~F.col("connection_direction"), "incoming")
    return rows.select(_line(fields).alias("value"))


def sidecar_lines(rows: DataFrame) -> DataFrame:
    """One JSON line for each closed connection; an unknown process is an explicit null."""
    time = lambda us: F.struct(F.expr(f"{us} div 1000000").alias("secs_since_epoch"), F.expr(f"({us} % 1000000) * 1000").alias("nanos_since_epoch"))
    fields = {
        "bytes_received": F.col("bytes_received"), "bytes_sent": F.col("bytes_sent"), "first_seen": time("created_us"), "last_seen": time("last_us"),
        "local_addr": endpoint(F.col("local_ip"), F.col("local_port")), "remote_addr": endpoint(F.col("remote_ip"), F.col("remote_port")),
        "process_name": F.col("process_name"), "pid": F.col("pid") if "pid" in rows.columns else F.lit(None).cast("long"), "protocol": F.col("protocol"), "state": F.col("state"),
    }
    fields |= {c: F.col(c) for c in OPTIONAL if c in rows.columns and c not in ("destination_hostname", "source_hostname", "service_name", "dpi_protocol", "dpi_domain", "pid")} | _kinds(rows, "local_addr_kind", "remote_addr_kind", "remote_is_gateway")
    return rows.select(_line(fields, ("pid", "process_name")).alias("value"))


def comment(tool: str, fields: dict[str, Column]) -> Column:
    """`tool key=value ...` of the fields that have a value; NULL without any."""
    parts = [F.when(comment_value(v).isNotNull(), F.concat(F.lit(f"{k}="), comment_value(v))) for k, v in fields.items()]
    joined = F.concat_ws(" ", *parts)
    return F.when(joined != "", F.concat(F.lit(f"{tool} "), joined))


#: Keys of a connection's comment, in order, with the columns that they show.
COMMENT_KEYS = {"process": "process_name", "pid": "pid", "ppid": "process_ppid", "uid": "process_uid", "attr": "attribution_match"}
POD_KEYS = {"pod": "pod_name", "ns": "pod_namespace", "pod_uid": "pod_uid", "container": "container_name", "container_id": "container_id"}
LAST_KEYS = {"app": "application", "sni": "dpi_domain", "country": "geoip_country_code", "asn": "geoip_asn"}


def connection_comment(rows: DataFrame, tool: str = "flow") -> Column:
    """The comment of a connection: its owner, pod, direction, application, name and place, of the columns that rows has; NULL if none has a value.

    `kubernetes` is a struct; fields that it lacks are left out. The name is shown only beside an application.
    """
    pod = rows.schema["kubernetes"].dataType.fieldNames() if "kubernetes" in rows.columns else []
    text = lambda c: F.col(c).cast("string")
    fields = {k: text(c) for k, c in COMMENT_KEYS.items() if c in rows.columns}
    fields |= {k: text(f"kubernetes.{c}") for k, c in POD_KEYS.items() if c in pod}
    if "connection_direction" in rows.columns:
        fields["direction"] = F.when(F.col("connection_direction"), "outgoing").when(~F.col("connection_direction"), "incoming")
    fields |= {k: text(c) for k, c in LAST_KEYS.items() if c in rows.columns}
    if "sni" in fields:
        fields["sni"] = F.when(F.col("application").isNotNull(), fields["sni"]) if "app" in fields else F.lit(None).cast("string")
    return comment(tool, fields)


#: Columns of the tab-separated report, in order.
REPORT = ["frame", "time", "proto", "src", "dst", "country", "city", "postal_code", "asn", "as_org", "pid", "process"]


def tab_lines(packets: DataFrame) -> DataFrame:
    """frame and the line of each packet (REPORT's columns, time in seconds) for a tab-separated report: six decimals of time, nothing for an absent value or a pid or asn of 0."""
    absent = F.lit("")
    number = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    told = {"frame": F.col("frame").cast("string"), "time": F.format_string("%.6f", F.col("time")), "asn": number("asn"), "pid": number("pid")}
    return packets.select("frame", F.concat_ws("\t", *(F.coalesce(told.get(c, F.col(c)), absent) for c in REPORT)).alias("value"))


def table_lines(packets: DataFrame) -> DataFrame:
    """frame and the line of each packet for a table to read: columns of fixed width, long names cut with ..., - for an absent value."""
    short = lambda c: F.when(F.length(c) > 15, F.concat(F.substring(c, 1, 12), F.lit("..."))).otherwise(F.when(F.col(c) != "", F.col(c)))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    left = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    right = lambda c, n: F.when(F.length(c) < n, F.lpad(c, n, " ")).otherwise(c)
    cells = [
        right(F.col("frame").cast("string"), 6), left(dash(F.col("proto")), 5), left(dash(F.substring("src", 1, 22)), 22), left(dash(F.substring("dst", 1, 22)), 22), left(dash(F.nullif(F.col("country"), F.lit(""))), 4),
        left(dash(short("city")), 15), right(dash(F.concat(F.lit("AS"), nonzero("asn"))), 8), right(dash(nonzero("pid")), 7), left(dash(short("process")), 15),
    ]
    return packets.select("frame", F.concat_ws(" ", *cells).alias("value"))


def unique_connections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """connections: distinct (keys, first_us, pid) of sidecar lines, whichever end a line names first (keys: the two ends, then the rest)."""
    a, b, *rest = keys
    ends = F.array_sort(F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return lines.select(ends, *rest, "first_us", "pid").distinct().agg(F.count(F.lit(1)).alias("connections"))


def report(packets: DataFrame) -> DataFrame:
    """Packets, and how many of them have a process, by process."""
    return packets.groupBy(F.coalesce("process_name", F.lit("<none>")).alias("process")).agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes"))


def totals(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count(F.lit(1)).alias("packets"), F.count("process_name").alias("attributed"), F.round(F.count("process_name") * 100 / F.count(F.lit(1)), 6).alias("attributed_pct"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)
