"""Orders, with every tie broken by a key so that results do not depend on partitions."""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import ip_sort_key
from netquarry.plans.packets import FLOW

PROTOCOL_ORDER = ["TCP", "UDP", "ICMP", "IGMP", "ARP"]
DESCENDING_BY_DEFAULT = ("bandwidth", "rtt")


def protocol_rank(protocol: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PROTOCOL_ORDER)), protocol)


def connection_keys(column: str) -> list[Column]:
    """Sort keys of one of the ten orders of a connection table."""
    end = lambda s: [ip_sort_key(F.col(f"{s}_ip")), F.col(f"{s}_port")]
    return {
        "created": [F.col("created_us")],
        "bandwidth": [F.when(F.coalesce(F.col("is_historic"), F.lit(False)), 0.0).otherwise(F.col("rate_in") + F.col("rate_out"))],
        "process": [F.coalesce(F.col("process_name"), F.lit(""))],
        "local": end("local"),
        "remote": end("remote"),
        "location": [F.coalesce(F.col("country_code"), F.lit(""))],
        "application": [F.col("application"), protocol_rank(F.col("protocol"))],
        "service": [F.coalesce(F.col("service_name"), F.lit(""))],
        "state": [F.col("state")],
        "rtt": [F.coalesce(F.col("rtt_us"), F.lit(0))],
    }[column]


def _order(column: str, descending: bool | None, tie: list[str] | None) -> list[Column]:
    descending = column in DESCENDING_BY_DEFAULT if descending is None else descending
    keys = [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in connection_keys(column)]
    return [*keys, *map(F.asc, tie or ["created_us", *FLOW])]


def order_connections(rows: DataFrame, column: str, descending: bool | None = None, tie: list[str] | None = None) -> DataFrame:
    return rows.orderBy(*_order(column, descending, tie))


def connection_positions(rows: DataFrame, column: str, descending: bool | None = None, tie: list[str] | None = None) -> DataFrame:
    """Every connection with its place in one of the ten orders."""
    return positions(rows, *_order(column, descending, tie))


def positions(rows: DataFrame, *keys: Column, name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in a total order of the whole table.

    The table is sorted by range partitions, and a row's place is its place in its
    partition behind the partitions before; only their sizes are gathered. The sorted
    rows are written once, so that both readings see the same partitions.
    """
    numbered = rows.orderBy(*keys).withColumn("__id", F.monotonically_increasing_id())
    numbered = numbered.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else numbered.persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("__id", 33)
    sizes = dict(numbered.groupBy(part.alias("part")).count().collect())
    before = dict(zip(sorted(sizes), itertools.accumulate([0, *(sizes[k] for k in sorted(sizes))])))
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), part) if before else F.lit(0)
    return numbered.withColumn(name, (offset + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("__id")


def top(rows: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows: each task keeps n, and the driver merges those."""
    return rows.orderBy(*keys).limit(n)


def ranked(rows: DataFrame, *keys: Column, within: list[str] | None = None, name: str = "position") -> DataFrame:
    """Rows with their place in an order within groups, or of the whole table."""
    if not within:
        return positions(rows, *keys, name=name)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*keys)))


def activity_keys(metric: str, descending: bool = True) -> list[Column]:
    m = F.col(metric)
    return [m.desc() if descending else m.asc(), F.col("process_name").asc_nulls_first(), F.col("pid").asc_nulls_first()]


def newest(rows: DataFrame, by: str, n: int, *tie: str) -> DataFrame:
    """What a pool that evicts its oldest rows still holds."""
    return rows.orderBy(F.desc(by), *tie).limit(n)


def visible_processes(rows: DataFrame, metric: str, most: int = 10) -> DataFrame:
    """The processes that a listing shows."""
    return top(rows, most, *activity_keys(metric))
