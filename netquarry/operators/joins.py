"""Dimension lookups, as-of attribution and interval joins.

Dimension tables (services, vendors, sockets, processes) go to all tasks only
below the session's broadcast threshold, by Spark's own choice; no hint forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import ip4_number, ip6_hex, mac_prefix

SECOND = 1_000_000


def with_service(rows: DataFrame, services: DataFrame) -> DataFrame:
    """service_name by the remote port, else by the local one."""
    side = lambda s: services.select(F.lower("protocol").alias(f"__p{s}"), F.col("port").alias(f"__{s}"), F.col("name").alias(f"__n{s}"))
    proto = F.lower("protocol")
    out = rows
    for s in ("remote", "local"):
        out = out.join(side(s), (proto == F.col(f"__p{s}")) & (F.col(f"{s}_port") == F.col(f"__{s}")), "left")
    return out.withColumn("service_name", F.coalesce("__nremote", "__nlocal")).drop(*(f"__{x}{s}" for s in ("remote", "local") for x in ("p", "n", "")))


def with_vendor(rows: DataFrame, mac: str, oui: DataFrame, name: str = "vendor") -> DataFrame:
    table = oui.select(F.lower("prefix").alias("__prefix"), F.col("vendor").alias(name))
    return rows.withColumn("__mac", mac_prefix(F.col(mac))).join(table, F.col("__mac") == F.col("__prefix"), "left").drop("__mac", "__prefix")


def exact_owner(rows: DataFrame, sockets: DataFrame) -> DataFrame:
    """Owners by the whole address pair; of several the one with the least pid."""
    keys = ["protocol", "local_ip", "local_port", "remote_ip", "remote_port"]
    return rows.join(sockets.groupBy(*keys).agg(F.min(F.struct("pid", "name")).alias("o")).select(*keys, "o.pid", "o.name"), keys, "left")


def relaxed_owner(rows: DataFrame, sockets: DataFrame, key: list[str]) -> DataFrame:
    """Owners by three looser keys, tightest first; flows with two different owners get none.

    1 wildcard local address, 2 the address without peer, 3 the port alone.
    """
    wild, none = F.lit("0.0.0.0"), F.lit(0)
    option = lambda rank, li, ri, rp: F.struct(F.lit(rank).alias("rank"), li.alias("li"), F.col("local_port").alias("lp"), ri.alias("ri"), rp.alias("rp"))
    options = F.array(option(1, wild, F.col("remote_ip"), F.col("remote_port")), option(2, F.col("local_ip"), wild, none), option(3, wild, wild, none))
    asked = rows.where(F.col("protocol").isin("TCP", "UDP")).select(*key, F.col("protocol").alias("__proto"), F.explode(options).alias("o")).select(*key, "__proto", "o.*")
    s = sockets.select(F.col("protocol").alias("__proto"), F.col("local_ip").alias("li"), F.col("local_port").alias("lp"), F.col("remote_ip").alias("ri"), F.col("remote_port").alias("rp"), "pid", "name")
    hits = asked.join(s, ["__proto", "li", "lp", "ri", "rp"])
    best = hits.groupBy(*key).agg(F.count_distinct("pid").alias("owners"), F.min_by(F.struct("pid", "name", "rank"), F.struct("rank", "pid")).alias("b"))
    return best.where("owners = 1").select(*key, "b.pid", "b.name", F.col("b.rank").alias("quality"))


def as_of(left: DataFrame, right: DataFrame, key: str, tolerance_us: int, forward: bool = False, value: str = "name") -> DataFrame:
    """For each row of left (at, id) the nearest value of right by key, at most tolerance_us before (or after); of equal times the least value.

    Both sides go through one window: by key and a time bucket as wide as the tolerance,
    in order of time, each left row takes the last value passed. Right rows stand in
    their own bucket and the one behind it, so one popular key is spread over its
    buckets, and the work grows with the rows, not with the pairs of a bucket.
    """
    bucket, near = F.expr(f"at div {tolerance_us}"), -1 if forward else 1
    asked = left.select(F.col(key).alias("__k"), bucket.alias("__b"), "at", F.lit(True).alias("__asks"), "id", F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    held = right.select(F.col(key).alias("__k"), F.explode(F.array(bucket, bucket + near)).alias("__b"), "at", F.lit(False).alias("__asks"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), F.col(value).alias("__v"))
    time = F.desc("at") if forward else F.asc("at")
    passed = Window.partitionBy("__k", "__b").orderBy(time, F.asc("__asks"), F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(~F.col("__asks") & F.col("__v").isNotNull(), F.struct("__v", "at")), ignorenulls=True).over(passed)
    found = asked.unionByName(held).withColumn("m", seen).where("__asks and m is not null").where(F.abs(F.col("m.at") - F.col("at")) <= tolerance_us)
    return found.select("id", F.col("m.__v").alias(value), F.col("m.at").alias("observed_at"))


def attribute(flows: DataFrame, answers: DataFrame, key: str, tolerance_us: int = 10 * SECOND) -> DataFrame:
    """The freshest name before a flow's start, else the first one after it."""
    back = as_of(flows, answers, key, tolerance_us).select("id", F.col("name").alias("__back"))
    ahead = as_of(flows, answers, key, tolerance_us, forward=True).select("id", F.col("name").alias("__ahead"))
    joined = flows.join(back, "id", "left").join(ahead, "id", "left")
    return joined.withColumn("hostname", F.rtrim(F.coalesce("__back", "__ahead"), F.lit("."))).drop("__back", "__ahead")


def by_range(rows: DataFrame, ip: str, ranges: DataFrame, values: list[str]) -> DataFrame:
    """Values of the narrowest range (lo, hi, prefix) that holds an IPv4 address.

    Ranges are exploded to the /16 blocks they touch, so the join is by block; a
    /8 makes 256 rows, and tables of ranges are bounded by the address space.
    """
    blocks = ranges.withColumn("__b", F.explode(F.sequence(F.expr("lo div 65536"), F.expr("hi div 65536"))))
    asked = rows.select(F.col(ip).alias("__ip")).distinct().withColumn("__n", ip4_number(F.col("__ip"))).withColumn("__b", F.expr("__n div 65536"))
    hit = asked.join(blocks, "__b").where(F.col("__n").between(F.col("lo"), F.col("hi")))
    best = hit.groupBy("__ip").agg(F.max_by(F.struct(*values), F.struct("prefix", "lo")).alias("v")).select("__ip", "v.*")
    return rows.join(best, rows[ip] == best["__ip"], "left").drop("__ip")


def block_digits(digits: Column, prefix: Column) -> Column:
    """The first `prefix` bits of an address in hex digits, the last digit with its unused bits cleared."""
    whole, rest = F.floor(prefix / 4).cast("int"), prefix % 4
    last = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    keep = F.when(rest == 1, 8).when(rest == 2, 12).otherwise(14)
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(rest == 0, "").otherwise(F.hex(last.bitwiseAND(keep))))


def address_digits(ip: Column) -> Column:
    """An address as hex digits: 8 for IPv4, 32 for IPv6; NULL if it is none."""
    return F.when(ip.contains(":"), F.upper(ip6_hex(ip))).otherwise(F.lpad(F.hex(ip4_number(ip)), 8, "0"))


def by_prefix(rows: DataFrame, ip: str, blocks: DataFrame, cidr: str, values: list[str]) -> DataFrame:
    """Values of the longest block (a.b.c.d/n or x::y/n) that holds an address, IPv4 or IPv6; of equal blocks the greatest values.

    An address asks once for each prefix length that the table has (161 at most), by an equi-join on
    family, length and the masked bits; addresses are asked for once each, however often they occur.
    """
    length = F.split_part(cidr, F.lit("/"), F.lit(2)).cast("int")
    held = blocks.select(*values, address_digits(F.split_part(cidr, F.lit("/"), F.lit(1))).alias("__d"), length.alias("__p")).where("__d is not null and __p is not null")
    held = held.select(*values, "__p", F.length("__d").alias("__f"), block_digits(F.col("__d"), F.col("__p")).alias("__m"))
    lengths = held.groupBy("__f").agg(F.collect_set("__p").alias("__all"))
    asked = rows.select(F.col(ip).alias("__ip")).distinct().withColumn("__d", address_digits(F.col("__ip"))).withColumn("__f", F.length("__d"))
    asked = asked.join(F.broadcast(lengths), "__f").select("__ip", "__d", "__f", F.explode("__all").alias("__p"))
    hit = asked.withColumn("__m", block_digits(F.col("__d"), F.col("__p"))).join(held, ["__f", "__p", "__m"])
    best = hit.groupBy("__ip").agg(F.max_by(F.struct(*values), F.struct("__p", *values)).alias("v")).select("__ip", "v.*")
    return rows.join(best, rows[ip] == best["__ip"], "left").drop("__ip")


def geolocated(rows: DataFrame, ip: str, countries: DataFrame, systems: DataFrame, cities: DataFrame) -> DataFrame:
    """Country, autonomous system and city of public addresses; a city's country stands in where the country table has none.

    countries (cidr, country_code, country_name), systems (cidr, asn, as_org), cities (cidr, postal_code, city, country_code,
    country_name). Private, local, documentation and shared addresses are not looked up; has_data says whether anything was found.
    """
    asked = rows.select(F.col(ip).alias("__a")).distinct().where(~unrouted(F.col("__a")))
    renamed = cities.withColumnsRenamed({"country_code": "__city_code", "country_name": "__city_name"})
    found = by_prefix(by_prefix(by_prefix(asked, "__a", countries, "cidr", ["country_code", "country_name"]), "__a", systems, "cidr", ["asn", "as_org"]), "__a", renamed, "cidr", ["postal_code", "city", "__city_code", "__city_name"])
    own = F.col("country_code").isNotNull()
    told = found.withColumns({"country_name": F.when(own, F.col("country_name")).otherwise(F.col("__city_name")), "country_code": F.coalesce("country_code", "__city_code")}).drop("__city_code", "__city_name")
    values = ["country_code", "country_name", "asn", "as_org", "postal_code", "city"]
    return rows.join(told, rows[ip] == told["__a"], "left").drop("__a").withColumn("has_data", F.coalesce(*(F.col(v).cast("string") for v in values)).isNotNull())


# Private, loopback, link-local, broadcast, documentation, unspecified and shared IPv4 blocks; loopback, unspecified, link-local and unique local IPv6, in hex digits.
UNROUTED_4 = "^(?:0A|7F|C0A8|A9FE|FFFFFFFF|C00002|C63364|CB0071|00000000|AC1|64[4-7])"
UNROUTED_6 = "^(?:0{31}[01]|FE[89AB]|F[CD])"


def unrouted(ip: Column) -> Column:
    """Addresses that no location is looked up for; also what is no address."""
    digits = address_digits(ip)
    return F.when(ip.contains(":"), digits.rlike(UNROUTED_6)).otherwise(F.coalesce(digits.rlike(UNROUTED_4), F.lit(True)))


def flagged(rows: DataFrame, column: str, members: DataFrame, member: str, name: str) -> DataFrame:
    """A flag for membership in a list of addresses."""
    marks = members.select(F.col(member).alias("__m")).distinct().withColumn("__hit", F.lit(True))
    return rows.join(marks, rows[column] == marks["__m"], "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__m", "__hit")


def interval_match(packets: DataFrame, spans: DataFrame, keys: list[str], slack_us: int) -> DataFrame:
    """For each packet the span (first_us, last_us, line) of its key that holds its time within slack; nearest first, ties by line.

    A span stands in buckets as wide as the power of two above its length, so in two at
    most however long it is, and a packet asks once for each width that occurs (64 at most)
    with a span about its time. Of equal spans of a key only the one with the least line can
    win, so they are one before they are shuffled.
    """
    lo, hi = F.col("first_us") - slack_us, F.col("last_us") + slack_us
    wide = lambda rows: rows.withColumns({"__lo": lo, "__hi": hi, "__l": F.length(F.bin(hi - lo))})
    bucket = lambda at: F.expr(f"({at} - pmod({at}, shiftleft(1L, __l))) div shiftleft(1L, __l)")
    some = spans.where(hi >= lo)
    one = wide(some.groupBy(*keys, "first_us", "last_us").agg(F.min("line").alias("line")))
    held = one.withColumn("__b", F.explode(F.array_distinct(F.array(bucket("__lo"), bucket("__hi"))))).drop("__lo", "__hi")
    reach = sorted(tuple(r) for r in wide(some).groupBy("__l").agg(F.min("__lo"), F.max("__hi")).collect())
    widths = F.array(*(F.when(F.col("us").between(first, last), F.lit(width)) for width, first, last in reach)) if reach else F.array()
    asked = packets.withColumn("__l", F.explode(F.array_compact(widths.cast("array<int>")))).withColumn("__b", bucket("us"))
    outside = F.greatest(F.col("first_us") - F.col("us"), F.col("us") - F.col("last_us"), F.lit(0))
    near = asked.join(held, [*keys, "__l", "__b"]).where(F.col("us").between(F.col("first_us") - slack_us, F.col("last_us") + slack_us))
    return near.groupBy("frame_no").agg(F.min_by("line", F.struct(outside, "line")).alias("line"), F.min(outside).alias("distance_us"))


def lineage(processes: DataFrame, levels: int = 4) -> DataFrame:
    """Up to `levels` ancestors of each process, oldest first, without cycles, and whether more were cut off."""
    parent = processes.select(F.col("pid").alias("__pid"), F.col("ppid").alias("__ppid"), F.col("name").alias("__name"))
    out = processes.withColumns({"ancestors": F.array().cast("array<struct<pid:bigint,name:string>>"), "__next": F.col("ppid"), "__seen": F.array("pid")})
    for _ in range(levels):
        step = out.join(parent, (F.col("__next") == F.col("__pid")) & ~F.array_contains("__seen", F.col("__next")), "left")
        found = F.col("__pid").isNotNull()
        one = F.array(F.struct(F.col("__pid").cast("long").alias("pid"), F.col("__name").alias("name")))
        out = step.withColumns({"ancestors": F.when(found, F.concat(one, "ancestors")).otherwise(F.col("ancestors")), "__seen": F.when(found, F.concat("__seen", F.array("__pid"))).otherwise(F.col("__seen")), "__next": F.col("__ppid")}).drop("__pid", "__ppid", "__name")
    more = parent.select("__pid")
    cut = F.col("__pid").isNotNull() & ~F.array_contains("__seen", F.col("__next"))
    return out.join(more, F.col("__next") == F.col("__pid"), "left").withColumn("truncated", F.coalesce(cut, F.lit(False))).drop("__next", "__seen", "__pid")


def completed_only(active: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    return completed.join(active.select(*keys).distinct(), keys, "left_anti")


def first_known(*columns: Column, unknown: str = "Unknown") -> Column:
    """Write-once enrichment: the first value, but a known name replaces an unknown one."""
    return F.coalesce(F.nullif(columns[0], F.lit(unknown)), *columns[1:], columns[0])


def newest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def with_neighbour(rows: DataFrame, latest: DataFrame, ip: str = "remote_ip", name: str = "remote_mac") -> DataFrame:
    """The newest link address known for an address, from aggregates.neighbours()."""
    table = latest.select(F.col("ip").alias("__ip"), F.col("mac").alias(name))
    return rows.join(table, rows[ip] == table["__ip"], "left").drop("__ip")


def kernel_owner(rows: DataFrame, kernel: DataFrame, sockets: DataFrame, key: list[str]) -> DataFrame:
    """Owners as the kernel saw them by exact tuple, else as the socket table has them, exactly or loosely; quality says which."""
    keys = ["protocol", "local_ip", "local_port", "remote_ip", "remote_port"]
    one = kernel.groupBy(*keys).agg(F.min(F.struct("pid", "name")).alias("__kernel"))
    two = sockets.groupBy(*keys).agg(F.min(F.struct("pid", "name")).alias("__exact"))
    loose = relaxed_owner(rows, sockets, key).select(*key, F.struct("pid", "name").alias("__loose"))
    found = rows.join(one, keys, "left").join(two, keys, "left").join(loose, key, "left")
    best = F.coalesce("__kernel", "__exact", "__loose")
    quality = F.when(F.col("__kernel").isNotNull(), "exact-tuple").when(F.col("__exact").isNotNull(), "procfs-exact").when(F.col("__loose").isNotNull(), "procfs-relaxed").otherwise("unspecified")
    return found.withColumns({"pid": best["pid"], "name": best["name"], "quality": quality}).drop("__kernel", "__exact", "__loose")


def of_generation(rows: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Notes only for rows of the very generation that they were made for: equal keys and creation time."""
    return rows.join(notes, [*keys, "created_us"], "left")
