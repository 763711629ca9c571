"""Rates and time series as window expressions over packets or samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import per_second
from netquarry.plans.packets import FLOW

SECOND = 1_000_000


def sliding_rate(packets: DataFrame, window_s: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Per packet, bytes a second each way over the last window_s seconds of its flow.

    A flow's first packet is no sample. The rate is the sum of the window's samples
    over the time between its oldest and newest one; 0 under two samples or one second.
    """
    keys = keys or FLOW
    order = Window.partitionBy(*keys).orderBy("us", "frame_no")
    samples = packets.withColumn("nth", F.row_number().over(order)).where("nth > 1")
    frame = Window.partitionBy(*keys).orderBy("us").rangeBetween(-window_s * SECOND, 0)
    span = (F.col("us") - F.min("us").over(frame)) / SECOND
    out = F.col("is_outgoing")
    rate = lambda mine: F.when((F.count("us").over(frame) < 2) | (span < 1), 0.0).otherwise(F.sum(F.when(mine, F.col("packet_len")).otherwise(0)).over(frame) / span)
    return samples.withColumns({"rate_out": F.round(rate(out), 6), "rate_in": F.round(rate(~out), 6)})


def final_rates(packets: DataFrame, window_s: int = 10) -> DataFrame:
    """Each flow's rate at its last packet."""
    rates = sliding_rate(packets, window_s)
    return rates.groupBy(*FLOW).agg(F.max_by(F.struct("rate_in", "rate_out"), F.struct("us", "frame_no")).alias("r")).select(*FLOW, "r.*")


def ticks(packets: DataFrame, keys: list[str], tick_us: int = SECOND) -> DataFrame:
    """Bytes and packets by key and tick; partial sums before the shuffle."""
    out = F.col("is_outgoing")
    return packets.groupBy(*keys, F.expr(f"us div {tick_us}").alias("tick")).agg(
        F.sum(F.when(out, F.col("packet_len")).otherwise(0)).alias("tx"),
        F.sum(F.when(out, 0).otherwise(F.col("packet_len"))).alias("rx"),
        F.count(F.lit(1)).alias("packets"),
        F.count_if("rst").alias("resets"),
    )


def saturating_delta(counter: str, by: Window) -> Column:
    """Growth of a counter since the row before; 0 if it fell; all of it at first."""
    return F.greatest(F.col(counter) - F.lag(counter, 1, 0).over(by), F.lit(0))


def counter_deltas(samples: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("tick")
    return samples.withColumns({f"d_{c}": saturating_delta(c, by) for c in counters})


def running(samples: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Cumulative counters, as a tracker would report them."""
    by = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumns({f"total_{v}": F.sum(v).over(by) for v in values})


def peak_rates(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rate between a key's samples and its highest so far."""
    by = Window.partitionBy(*keys).orderBy("tick")
    before = F.lag("tick").over(by)
    rated = samples.withColumn("rate", F.coalesce(F.col(value) / (F.col("tick") - before), F.lit(0.0)))
    return rated.withColumn("peak", F.max("rate").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def bytes_in_window(samples: DataFrame, keys: list[str], total: str, seconds: int = 60) -> DataFrame:
    """Growth of a running total over the last seconds: against the last sample at or before the window's start, else 0."""
    by = Window.partitionBy(*keys).orderBy("tick")
    before = F.last(total).over(by.rangeBetween(Window.unboundedPreceding, -seconds))
    return samples.withColumn("window_bytes", F.col(total) - F.coalesce(before, F.lit(0)))


def truncated_mean(value: str, rows: int, by: Window) -> Column:
    """Trailing mean of integers, rounded down."""
    frame = by.rowsBetween(-(rows - 1), 0)
    return F.floor(F.sum(value).over(frame) / F.count(value).over(frame)).cast("long")


def rounded_mean(value: str, rows: int, by: Window) -> Column:
    """Trailing mean of integers, rounded to the nearest, halves up."""
    frame = by.rowsBetween(-(rows - 1), 0)
    n = F.count(value).over(frame)
    return F.floor((F.sum(value).over(frame) + F.floor(n / 2)) / n).cast("long")


def traffic_series(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Smoothed traffic and loss by tick within keys."""
    by = Window.partitionBy(*keys).orderBy("tick")
    return samples.withColumns(
        {
            "tx_smooth": truncated_mean("tx", 3, by),
            "rx_smooth": truncated_mean("rx", 3, by),
            "opened_smooth": rounded_mean("packets", 3, by),
            "closed_smooth": rounded_mean("resets", 10, by),
            "loss_pct": F.round(F.col("resets") * 100.0 / F.col("packets"), 6),
        }
    )


def health_average(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Three-sample moving average from the third sample on; a key with fewer samples keeps its raw values."""
    by = Window.partitionBy(*keys).orderBy("tick")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    row = F.row_number().over(by)
    mean = F.avg(value).over(by.rowsBetween(-2, 0))
    marked = samples.withColumns({"__n": n, "__row": row, "health": F.when(n < 3, F.col(value).cast("double")).otherwise(F.round(mean, 6))})
    return marked.where("__n < 3 or __row >= 3").drop("__n", "__row")


def next_power_of_two(x: Column) -> Column:
    """The smallest power of two not below x, exactly."""
    bits = F.length(F.bin(F.greatest(x.cast("long"), F.lit(1)) - 1))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L").bitwiseOR(F.lit(0).cast("long")) * F.pow(F.lit(2.0), bits).cast("long"))


def ceilings(samples: DataFrame, keys: list[str], value: str, least: int = 1024, rows: int = 120) -> DataFrame:
    """The scale of a graph of the last `rows` samples."""
    by = Window.partitionBy(*keys).orderBy("tick").rowsBetween(-(rows - 1), 0)
    return samples.withColumn("ceiling", next_power_of_two(F.greatest(F.max(value).over(by), F.lit(least))))


def last_samples(samples: DataFrame, keys: list[str], n: int = 120) -> DataFrame:
    """A ring of the newest n samples."""
    by = Window.partitionBy(*keys).orderBy(F.desc("tick"))
    return samples.withColumn("age", F.row_number().over(by)).where(F.col("age") <= n)


def sparkline(samples: DataFrame, keys: list[str], value: str, n: int = 10) -> DataFrame:
    """The newest n values, oldest first; at most n a key are collected."""
    kept = last_samples(samples, keys, n)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("tick", value))), lambda s: s[value]).alias("line"))


def mini_wave(samples: DataFrame, keys: list[str], value: str, n: int = 120) -> DataFrame:
    """Scale of a small wave: nearest-rank 90th percentile of trailing four-sample means of the last n, at least 1024, to the next power of two."""
    by = Window.partitionBy(*keys).orderBy("tick")
    smooth = last_samples(samples.withColumn("wave", truncated_mean(value, 4, by)), keys, n)
    lists = smooth.groupBy(*keys).agg(F.array_sort(F.collect_list("wave")).alias("w"))
    p90 = F.element_at("w", F.greatest(F.ceil(F.size("w") * 0.9), F.lit(1)).cast("int"))
    return lists.select(*keys, next_power_of_two(F.greatest(p90, F.lit(1024))).alias("scale"))


def interface_rates(counters: DataFrame, keys: list[str], value: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("tick")
    seconds = F.col("tick") - F.lag("tick").over(by)
    return counters.withColumn("rate", F.coalesce(F.floor(saturating_delta(value, by) / seconds), F.lit(0)).cast("long"))


def tick_rates(samples: DataFrame, keys: list[str], value: str, tick_s: float) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("tick")
    seconds = (F.col("tick") - F.lag("tick").over(by)) * tick_s
    return samples.withColumn("per_second", F.coalesce(per_second(F.col(value), seconds), F.lit(0)))


def smoothed_rates(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A displayed rate over ticks. The rule is recursive, so a key's ticks are folded in order; ticks bound a key's list, not packets."""
    lists = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tick", F.col(value).cast("double").alias("raw")))).alias("s"))
    rule = lambda raw, prev: F.when(raw >= prev, raw).when(raw == 0, prev * 0.15).otherwise(0.6 * raw + 0.4 * prev)
    step = lambda acc, x: F.transform(F.array(rule(x["raw"], acc)), lambda v: F.when(v < 1.0, 0.0).otherwise(v))[0]
    return lists.select(*keys, F.round(F.aggregate("s", F.lit(0.0), step), 6).alias("smoothed"))


def recent_average(samples: DataFrame, keys: list[str], at: str, value: str, seconds: int, most: int = 100) -> DataFrame:
    """Mean of the newest `most` samples of each key that are at most `seconds` older than the key's newest."""
    by = Window.partitionBy(*keys)
    ring = samples.withColumn("__k", F.row_number().over(by.orderBy(F.desc(at), F.desc("frame_no")))).where(F.col("__k") <= most)
    fresh = ring.where(F.col("__k") >= 1).withColumn("__new", F.max(at).over(by)).where(F.col(at) >= F.col("__new") - seconds * SECOND)
    return fresh.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("samples"))
