"""Groupings of the connection table and of process activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import ip_sort_key, percentage
from netquarry.plans.packets import choose

APPLICATIONS = ["HTTPS", "QUIC", "HTTP", "DNS", "SSH"]


def application_shares(rows: DataFrame) -> DataFrame:
    """Number and percentage of connections by application, in a fixed order, all others in one line."""
    app = F.col("application")
    counts = [F.count_if(app == a).alias(a) for a in APPLICATIONS] + [F.count_if(app.isNull() | ~app.isin(APPLICATIONS)).alias("Other")]
    one = rows.agg(*counts, F.count(F.lit(1)).alias("__n"))
    names = [*APPLICATIONS, "Other"]
    items = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(a).alias("application"), F.col(a).alias("connections")) for k, a in enumerate(names)))
    return one.select(F.explode(items).alias("i"), "__n").select("i.*", (F.col("i.connections") * 100 / F.greatest(F.col("__n"), F.lit(1))).alias("pct"))


def state_histogram(rows: DataFrame, states: list[str]) -> DataFrame:
    """Connections by TCP state, live TCP only, states that occur."""
    place = F.array_position(F.array(*map(F.lit, states)), F.col("state")).cast("int")
    return rows.where((F.col("protocol") == "TCP") & ~F.col("is_historic")).groupBy("state").agg(F.count(F.lit(1)).alias("connections")).withColumn("place", place)


def group_label() -> Column:
    name = F.col("process_name")
    return F.when(name.isNull() | (name == "Unknown"), "<unknown>").otherwise(name)


def process_groups(rows: DataFrame) -> DataFrame:
    """Counts and live rates by process."""
    live = ~F.col("is_historic")
    return rows.groupBy(group_label().alias("label")).agg(
        F.count_if(live).alias("active"),
        F.count_if(~live).alias("historic"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp"),
        F.count_if(F.col("protocol") == "UDP").alias("udp"),
        F.sum(F.when(live, F.col("bytes_received")).otherwise(0)).alias("total_in"),
        F.sum(F.when(live, F.col("bytes_sent")).otherwise(0)).alias("total_out"),
    )


def grouped_rows(rows: DataFrame, expanded: list[str]) -> DataFrame:
    """A header for each group and, for expanded ones, its connections with a mark on the last."""
    headers = process_groups(rows).select("label", F.lit(0).alias("level"), F.lit(0).cast("long").alias("seq"), (F.col("active") + F.col("historic")).alias("n"), F.lit(False).alias("is_last"))
    by = Window.partitionBy("label").orderBy("created_us", "local_port")
    children = rows.withColumn("label", group_label()).where(F.col("label").isin(expanded)).select("label", F.lit(1).alias("level"), F.row_number().over(by).cast("long").alias("seq"), F.lit(1).cast("long").alias("n"), F.lead("created_us").over(by).isNull().alias("is_last"))
    return headers.unionByName(children)


def connection_counts(rows: DataFrame) -> DataFrame:
    live = ~F.col("is_historic")
    return rows.agg(
        F.count_if(live).alias("active"),
        F.count_if(~live).alias("historic"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp"),
        F.count_if(F.col("protocol") == "UDP").alias("udp"),
        F.count_distinct("process_name").alias("processes"),
    )


def activity(rows: DataFrame, destinations: int = 256) -> DataFrame:
    """Traffic by process, in two levels: first by process and destination, then by process.

    Of equal destinations the larger address comes first; n_destinations stops at
    `destinations`, with a flag.
    """
    live = (~F.col("is_historic")).cast("int")
    ends = rows.groupBy("process_name", "remote_ip", "remote_port").agg(F.sum("bytes_sent").alias("tx"), F.sum("bytes_received").alias("rx"), F.sum(live).alias("active"), F.count(F.lit(1)).alias("total"))
    address = F.concat_ws(":", "remote_ip", F.col("remote_port").cast("string"))
    key = lambda c: F.struct(F.col(c), ip_sort_key(F.col("remote_ip")), "remote_port")
    return ends.groupBy("process_name").agg(
        F.sum("tx").alias("tx"),
        F.sum("rx").alias("rx"),
        F.sum("active").alias("active"),
        F.sum("total").alias("total"),
        F.least(F.count(F.lit(1)), F.lit(destinations)).alias("n_destinations"),
        (F.count(F.lit(1)) > destinations).alias("truncated"),
        F.max_by(address, key("tx")).alias("top_tx"),
        F.max_by(address, key("rx")).alias("top_rx"),
    )


def with_overflow(rows: DataFrame, keep: int) -> DataFrame:
    """Completed processes beyond the first `keep` by name become Other or Unknown.

    The place is found by counting sorted names, which are few against rows.
    """
    names = rows.select("process_name").distinct().orderBy(F.col("process_name").asc_nulls_first()).limit(keep).withColumn("kept", F.lit(True))
    names = names.withColumnRenamed("process_name", "__name")
    joined = rows.join(names, F.col("process_name").eqNullSafe(F.col("__name")), "left")
    other = F.when(F.col("process_name").isNull(), "Unknown").otherwise("Other")
    return joined.groupBy(F.when(F.coalesce("kept", F.lit(False)), F.coalesce("process_name", F.lit("Unknown"))).otherwise(other).alias("process")).agg(F.sum("bytes_sent").alias("tx"), F.sum("bytes_received").alias("rx"), F.count(F.lit(1)).alias("connections"))


def shares(rows: DataFrame, value: str, name: str = "share_pct") -> DataFrame:
    """Each row's percentage of the column's total, by one small aggregate joined back."""
    total = rows.agg(F.sum(value).alias("__total"))
    return rows.join(F.broadcast(total)).withColumn(name, percentage(F.col(value), F.col("__total"))).drop("__total")


def latest_by(rows: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """The newest row's values by key; of equal times the later frame."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def neighbours(packets: DataFrame) -> DataFrame:
    """The hardware address last learnt for each IP: ARP senders always, targets of replies, and what IPv6 neighbour messages teach where packets have ndp_ip and ndp_mac; newer wins, ties the later frame."""
    pair = lambda ip, mac: F.struct(F.col(ip).alias("ip"), F.col(mac).alias("mac"))
    arp = F.when(F.col("op") == "reply", F.array(pair("sender_ip", "sender_mac"), pair("target_ip", "target_mac"))).when(F.col("op").isNotNull(), F.array(pair("sender_ip", "sender_mac")))
    taught = F.when(F.col("ndp_mac").isNotNull(), F.array(pair("ndp_ip", "ndp_mac"))) if "ndp_mac" in packets.columns else F.lit(None)
    learnt = packets.select("us", "frame_no", F.explode(F.coalesce(arp, taught)).alias("l")).select("us", "frame_no", "l.*")
    bad_ip = F.col("ip").isin("0.0.0.0", "255.255.255.255", "::") | F.col("ip").rlike(r"^(?:2(2[4-9]|3\d)\.|[fF][fF])")
    bad_mac = (F.col("mac") == "00:00:00:00:00:00") | F.substring("mac", 2, 1).rlike("[13579bBdDfF]")  # group addresses have the lowest bit set
    return latest_by(learnt.where(~(bad_ip | bad_mac)), ["ip"], ["us", "frame_no"], "mac", "us")


def counters(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes"), F.count_if("is_outgoing").alias("sent"), F.count_if("rst").alias("resets"), F.count_distinct("user_id").alias("flows"))


def application_of(port: Column) -> Column:
    """The usual application of a port, for tables without payloads."""
    return choose(F.array_position(F.array(*map(F.lit, [443, 80, 53, 22, 123])), port), [None, "HTTPS", "HTTP", "DNS", "SSH", "NTP"])
