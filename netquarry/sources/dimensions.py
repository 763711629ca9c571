"""Dimension tables from the text files that systems keep, and their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.net import broadcast_of, hex_le_ip4, ip4_text

# Services known without a services file.
DEFAULT_SERVICES = [(20, "tcp", "ftp-data"), (21, "tcp", "ftp"), (22, "tcp", "ssh"), (23, "tcp", "telnet"), (25, "tcp", "smtp"), (53, "tcp", "dns"), (53, "udp", "dns"), (67, "udp", "dhcp"), (68, "udp", "dhcp"), (80, "tcp", "http"), (110, "tcp", "pop3"), (123, "udp", "ntp"), (143, "tcp", "imap"), (161, "udp", "snmp"), (443, "tcp", "https"), (443, "udp", "https"), (445, "tcp", "smb"), (993, "tcp", "imaps"), (3306, "tcp", "mysql"), (5353, "udp", "mdns"), (5432, "tcp", "postgresql"), (6379, "tcp", "redis"), (8080, "tcp", "http-alt"), (8443, "tcp", "https-alt")]


def default_services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_SERVICES, "port int, protocol string, name string")


def services(lines: DataFrame) -> DataFrame:
    """`name port/proto` lines (line_no, value), # comments, tcp and udp; the first line of a port stands."""
    found = lines.select("line_no", F.regexp_replace("value", "#.*", "").alias("v"))
    pattern = r"^\s*(\S+)\s+(\d+)/(tcp|udp)\b"
    rows = found.where(F.col("v").rlike(pattern)).select("line_no", F.regexp_extract("v", pattern, 1).alias("name"), F.regexp_extract("v", pattern, 2).cast("int").alias("port"), F.regexp_extract("v", pattern, 3).alias("protocol"))
    return rows.groupBy("port", "protocol").agg(F.min_by("name", "line_no").alias("name"))


def vendors(lines: DataFrame) -> DataFrame:
    """`AABBCC<tab>Vendor` lines; the first line of a prefix stands."""
    rows = lines.select("line_no", F.lower(F.split_part("value", F.lit("\t"), F.lit(1))).alias("prefix"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("vendor"))
    return rows.where(F.col("prefix").rlike("^[0-9a-f]{6}$") & (F.col("vendor") != "")).groupBy("prefix").agg(F.min_by("vendor", "line_no").alias("vendor"))


def gateways(lines: DataFrame) -> DataFrame:
    """Gateways of a kernel route table: default routes that are up and have one."""
    f = F.split(F.trim("value"), r"\s+")
    flags = F.conv(f[3], 16, 10).cast("long")
    return lines.where(F.size(f) >= 8).where((f[1] == "00000000") & (f[7] == "00000000") & (flags.bitwiseAND(3) == 3)).select(hex_le_ip4(f[2]).alias("ip")).distinct()


def sockets(lines: DataFrame, protocol: str) -> DataFrame:
    """Local and remote ends and inode of a kernel socket table."""
    f = F.split(F.trim("value"), r"\s+")
    end = lambda k: (hex_le_ip4(F.split_part(f[k], F.lit(":"), F.lit(1))), F.conv(F.split_part(f[k], F.lit(":"), F.lit(2)), 16, 10).cast("int"))
    (lip, lport), (rip, rport) = end(1), end(2)
    rows = lines.where(F.trim("value").rlike(r"^\d+: [0-9A-F]{8}:"))
    return rows.select(F.lit(protocol).alias("protocol"), lip.alias("local_ip"), lport.alias("local_port"), rip.alias("remote_ip"), rport.alias("remote_port"), f[9].cast("long").alias("inode"))


#: The counters that a system keeps for each interface.
COUNTERS = ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors", "rx_dropped", "tx_dropped", "collisions"]


def counters(files: DataFrame) -> DataFrame:
    """interface_name, ts_us and the nine COUNTERS from files (path, value, ts_us) like .../net/eth0/statistics/rx_bytes, one row a reading of an interface.

    A reading that misses a counter, or has one that is no whole number up to 2**63 - 1, is left out, as are other files;
    of a file read twice at one time the smaller value stands. Null paths, values and times are left out.
    """
    pattern = r"(?:^|/)net/([^/]+)/statistics/([a-z_]+)$"
    name, counter = (F.regexp_extract("path", pattern, k) for k in (1, 2))
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = files.select(name.alias("interface_name"), "ts_us", counter.alias("__counter"), F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long")).alias("__n"))
    found = rows.where(F.col("__counter").isin(COUNTERS) & F.col("ts_us").isNotNull()).groupBy("interface_name", "ts_us")
    wide = found.agg(*(F.min(F.when(F.col("__counter") == c, F.col("__n"))).alias(c) for c in COUNTERS))
    return wide.dropna(subset=COUNTERS)


def local_addresses(addresses: DataFrame) -> DataFrame:
    """Own addresses (ip, prefix) with their subnets' broadcasts, and the loopbacks."""
    own = addresses.select("ip", ip4_text(broadcast_of(F.col("ip"), F.col("prefix"))).alias("broadcast"))
    loops = addresses.sparkSession.createDataFrame([("127.0.0.1", None), ("::1", None)], "ip string, broadcast string")
    return own.withColumn("broadcast", F.when(F.col("broadcast") != "", F.col("broadcast"))).unionByName(loops).distinct()


def cidr_ranges(blocks: DataFrame, cidr: str) -> DataFrame:
    """lo, hi and prefix of IPv4 blocks in a.b.c.d/n form."""
    from netquarry.functions.net import ip4_number

    prefix = F.split_part(cidr, F.lit("/"), F.lit(2)).cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - prefix)
    lo = F.floor(ip4_number(F.split_part(cidr, F.lit("/"), F.lit(1))) / size).cast("long") * size
    return blocks.withColumns({"prefix": prefix, "lo": lo, "hi": lo + size - 1})


def socket_text(text: Column) -> Column:
    """ip and port of `1.2.3.4:80`, `[::1]:80` and `*:80`."""
    port = F.regexp_extract(text, r":(\d+)$", 1).cast("int")
    ip = F.regexp_replace(F.regexp_replace(text, r":(\d+|\*)$", ""), r"^\[(.*)\]$", "$1")
    return F.struct(F.when(ip != "*", ip).otherwise("0.0.0.0").alias("ip"), port.alias("port"))


def container_of(path: Column) -> Column:
    """Pod uid and container id in a control-group path."""
    uid = F.regexp_replace(F.regexp_extract(path, r"pod([0-9a-f]{8}[-_][0-9a-f_-]{27})", 1), "_", "-")
    return F.struct(F.nullif(uid, F.lit("")).alias("pod_uid"), F.nullif(F.regexp_extract(path, r"([0-9a-f]{64})", 1), F.lit("")).alias("container_id"))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Connection lines of a sidecar file; blank and broken ones, and those without both ends, are skipped."""
    time = "struct<secs_since_epoch: long, nanos_since_epoch: long>"
    schema = f"protocol string, local_addr string, remote_addr string, pid long, process_name string, bytes_sent long, bytes_received long, state string, first_seen {time}, last_seen {time}, broken string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "broken").json(path)
    us = lambda c: F.col(f"{c}.secs_since_epoch") * 1_000_000 + F.expr(f"{c}.nanos_since_epoch div 1000")
    kept = rows.where("broken is null and protocol is not null and local_addr is not null and remote_addr is not null")
    return kept.withColumns({"first_us": us("first_seen"), "last_us": us("last_seen"), "line": F.monotonically_increasing_id()}).drop("first_seen", "last_seen", "broken")
