"""Packet and connection tables.

packets() derives a packet table from an events table on a compressed clock;
connections() is the plain aggregate of a packet table by flow, in one shuffle
with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLOW = ["protocol", "local_ip", "local_port", "remote_ip", "remote_port"]

EPOCH_US = 1704067200000000  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(index: Column, values: list) -> Column:
    """values[index], without a join."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def packets(spark: SparkSession, sf_dir: str, step_us: int = 20_000) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    protocol = choose(u % 5, ["TCP", "TCP", "TCP", "UDP", "ICMP"])
    icmp, kind = u % 5 == 4, F.col("event_type")
    return table(spark, sf_dir, "events").select(
        e.alias("frame_no"),
        F.timestamp_micros(F.lit(EPOCH_US) + e * step_us).alias("ts"),
        (e * step_us).alias("us"),
        protocol.alias("protocol"),
        F.concat(F.lit("10.0.0."), (u % 200 + 1).cast("string")).alias("local_ip"),
        F.when(icmp, 0).otherwise((u + 40000).cast("int")).alias("local_port"),
        F.concat(F.lit("203.0.113."), (u % 50 + 1).cast("string")).alias("remote_ip"),
        F.when(icmp, 0).otherwise(choose(u % 6, [443, 80, 53, 22, 123, 8080])).alias("remote_port"),
        (e % 2 == 0).alias("is_outgoing"),
        (F.floor(F.col("value") * 10).cast("long") + 40).alias("packet_len"),
        (kind == "signup").alias("syn"),
        kind.isin("click", "view", "purchase").alias("ack_flag"),
        (kind == "purchase").alias("fin"),
        (kind == "error").alias("rst"),
        F.when(kind == "view", F.floor(F.col("value") * 10).cast("long")).otherwise(0).alias("payload_len"),
        ((e * 1460 + 4294000000) % 4294967296).alias("seq"),
        (((e - 1) * 1460 + 4294000000) % 4294967296).alias("ack"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("txid"),
        F.when((u % 7 != 0) & (e % 13 != 0), F.when(e % 11 == 3, "helper").otherwise(F.concat(F.lit("proc"), (u % 7).cast("string")))).alias("process_name"),
        u.alias("user_id"),
    )


PACKETS_SQL = """
packets as (
  select event_id as frame_no, event_id * {step} as us, make_timestamp(1704067200000000 + event_id * {step}) as ts,
    ['TCP','TCP','TCP','UDP','ICMP'][user_id % 5 + 1] as protocol, '10.0.0.' || (user_id % 200 + 1) as local_ip,
    case when user_id % 5 = 4 then 0 else cast(40000 + user_id as integer) end as local_port, '203.0.113.' || (user_id % 50 + 1) as remote_ip,
    case when user_id % 5 = 4 then 0 else [443,80,53,22,123,8080][user_id % 6 + 1] end as remote_port, event_id % 2 = 0 as is_outgoing,
    cast(floor(value * 10) as bigint) + 40 as packet_len, event_type = 'signup' as syn, event_type in ('click','view','purchase') as ack_flag,
    event_type = 'purchase' as fin, event_type = 'error' as rst, case when event_type = 'view' then cast(floor(value * 10) as bigint) else 0 end as payload_len,
    (4294000000 + event_id * 1460) % 4294967296 as seq, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as txid,
    case when user_id % 7 <> 0 and event_id % 13 <> 0 then case when event_id % 11 = 3 then 'helper' else 'proc' || (user_id % 7) end end as process_name, user_id from events)
"""


def packets_sql(step_us: int = 20_000) -> str:
    return PACKETS_SQL.format(step=step_us)


def connections(frames: DataFrame) -> DataFrame:
    """One row a flow: counters by direction, first and last activity, the first process name seen."""
    out = F.col("is_outgoing")
    return frames.groupBy(*FLOW).agg(
        F.sum(F.when(out, F.col("packet_len")).otherwise(0)).alias("bytes_sent"),
        F.sum(F.when(out, 0).otherwise(F.col("packet_len"))).alias("bytes_received"),
        F.count_if(out).alias("packets_sent"),
        F.count_if(~out).alias("packets_received"),
        F.min("us").alias("created_us"),
        F.max("us").alias("last_us"),
        F.min_by("process_name", F.when(F.col("process_name").isNotNull(), F.struct("us", "frame_no"))).alias("process_name"),
        F.max_by("txid", F.struct("us", "frame_no")).alias("last_txid"),
    )


CONNECTIONS_SQL = """
connections as (
  select protocol, local_ip, local_port, remote_ip, remote_port,
    cast(sum(case when is_outgoing then packet_len else 0 end) as bigint) as bytes_sent, cast(sum(case when is_outgoing then 0 else packet_len end) as bigint) as bytes_received,
    count(*) filter (is_outgoing) as packets_sent, count(*) filter (not is_outgoing) as packets_received,
    min(us) as created_us, max(us) as last_us, arg_min(process_name, frame_no) filter (process_name is not null) as process_name, max_by(txid, frame_no) as last_txid
  from packets group by all)
"""


def with_connections_sql(step_us: int = 20_000) -> str:
    return f"with {packets_sql(step_us)}, {CONNECTIONS_SQL}"
