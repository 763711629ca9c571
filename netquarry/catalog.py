"""Registered queries of the flow engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators import aggregates, decode, filters, joins, latency, lifecycle, sorts, windows
from netquarry.plans.packets import FLOW, connections, packets, packets_sql, table, with_connections_sql
from netquarry.sinks import events as sinks
from netquarry.sources import dimensions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SECOND = 1_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def flows(spark: SparkSession, d: str) -> DataFrame:
    """Connections with a service, an application, a state and a mark on those idle at the end."""
    c = connections(packets(spark, d))
    app = aggregates.application_of(F.col("remote_port"))
    state = F.when(F.col("protocol") == "TCP", F.when(F.col("last_txid") % 3 == 0, "ESTABLISHED").when(F.col("last_txid") % 3 == 1, "TIME_WAIT").otherwise("CLOSED")).otherwise(F.lit("ACTIVE"))
    return joins.with_service(c, dimensions.default_services(spark)).withColumns({"application": app, "state": state, "is_historic": F.col("last_txid") % 4 == 0})


_SERVICES = ", ".join(f"({p}, '{t}', '{n}')" for p, t, n in dimensions.DEFAULT_SERVICES)
FLOWS_SQL = with_connections_sql() + f""",
services(port, proto, name) as (values {_SERVICES}),
flows as (
  select c.*, coalesce(r.name, l.name) as service_name,
    case remote_port when 443 then 'HTTPS' when 80 then 'HTTP' when 53 then 'DNS' when 22 then 'SSH' when 123 then 'NTP' end as application,
    case when protocol <> 'TCP' then 'ACTIVE' when last_txid % 3 = 0 then 'ESTABLISHED' when last_txid % 3 = 1 then 'TIME_WAIT' else 'CLOSED' end as state,
    last_txid % 4 = 0 as is_historic
  from connections c left join services r on r.port = c.remote_port and r.proto = lower(c.protocol) left join services l on l.port = c.local_port and l.proto = lower(c.protocol))
"""
KEYS = "protocol, local_ip, local_port, remote_ip, remote_port"
P = f"with {packets_sql()}"


# -- flagship -------------------------------------------------------------------


@query("q0_top_processes", FLOWS_SQL + """
select coalesce(process_name, '<unknown>') as process, cast(sum(bytes_sent + bytes_received) as bigint) as bytes, count(*) as flows from flows
where protocol = 'TCP' and remote_port = 443 and lower(service_name) like '%http%' group by 1 order by bytes desc, process limit 5""")
def q0(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    kept = rows.where(filters.parse("proto:tcp dport:443 svc:http", rows.columns))
    by = kept.groupBy(F.coalesce("process_name", F.lit("<unknown>")).alias("process")).agg(F.sum(F.col("bytes_sent") + F.col("bytes_received")).alias("bytes"), F.count(F.lit(1)).alias("flows"))
    return sorts.top(by, 5, F.desc("bytes"), F.asc("process"))


# -- folding by aggregates (FL) --------------------------------------------------


@query("fl4_connections", with_connections_sql() + "select * from connections")
def fl4(spark: SparkSession, d: str) -> DataFrame:
    return connections(packets(spark, d))


@query("fl12_merge_sets", P + f""" select {KEYS}, list_sort(list_distinct(list(txid) filter (txid < 50)))[1:64]::varchar[] as ids, bool_or(rst) as any_reset, max_by(txid, frame_no) as last_txid from packets group by all""")
def fl12(spark: SparkSession, d: str) -> DataFrame:
    ids = F.slice(F.array_sort(F.collect_set(F.when(F.col("txid") < 50, F.col("txid")))), 1, 64)
    return packets(spark, d).groupBy(*FLOW).agg(F.nullif(ids, F.array().cast("array<long>")).cast("array<string>").alias("ids"), F.bool_or("rst").alias("any_reset"), F.max_by("txid", "frame_no").alias("last_txid"))


@query("fl9_first_and_last", P + f""" select {KEYS}, arg_min(txid, frame_no) filter (ack_flag) as first_seen, arg_max(txid, frame_no) filter (fin) as last_closed from packets group by all""")
def fl9(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by("txid", F.when(F.col("ack_flag"), F.col("frame_no")))
    return packets(spark, d).groupBy(*FLOW).agg(first.alias("first_seen"), F.max_by("txid", F.when(F.col("fin"), F.col("frame_no"))).alias("last_closed"))


@query("fl2_coalesced_keys", P + """, k as (select *, first_value(local_port) over (partition by txid order by frame_no) as home from packets where protocol = 'UDP')
select txid, home, count(*) as packets, cast(sum(packet_len) as bigint) as bytes from k group by all""")
def fl2(spark: SparkSession, d: str) -> DataFrame:
    udp = packets(spark, d).where("protocol = 'UDP'")
    first = udp.groupBy("txid").agg(F.min_by("local_port", "frame_no").alias("home"))
    return udp.groupBy("txid").agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes")).join(first, "txid").select("txid", "home", "packets", "bytes")


@query("fl16_timeouts", FLOWS_SQL + f""" select {KEYS}, case when protocol = 'ICMP' then 10 when protocol = 'UDP' then (case application when 'DNS' then 30 when 'NTP' then 30 when 'HTTP' then 600 when 'HTTPS' then 600 when 'SSH' then 1800 else 60 end)
  when state = 'ESTABLISHED' then (case application when 'SSH' then 1800 when 'HTTP' then 600 when 'HTTPS' then 600 else 300 end) when state = 'TIME_WAIT' then 30 else 15 end as timeout_s from flows""")
def fl16(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select(*FLOW, lifecycle.timeout_s(F.col("protocol"), F.col("state"), F.col("application")).alias("timeout_s"))


# Every flow's packets one after another: what is live, then whether the packet closes it (w), then what the packet makes of it.
GENERATIONS_SQL = f"""
with recursive {packets_sql(1_000_000)},
q as (select {KEYS}, row_number() over (partition by {KEYS} order by us, frame_no) as n, us, is_outgoing as o, packet_len as len, syn, ack_flag as a, fin, rst, payload_len as pay, seq, (frame_no * 1460 + 4293998540) % 4294967296 as ackno,
  case remote_port when 443 then 'HTTPS' when 80 then 'HTTP' when 53 then 'DNS' when 22 then 'SSH' when 123 then 'NTP' end as app from packets),
f as (
  select distinct {KEYS}, cast(0 as bigint) as n, false as live, cast(null as bigint) as tomb, cast(null as varchar) as state, cast(null as bigint) as created_us, cast(null as bigint) as last_us, cast(null as bigint) as terminal_us, cast(null as boolean) as direction,
    cast(0 as bigint) as bs, cast(0 as bigint) as br, cast(0 as bigint) as ps, cast(0 as bigint) as pr, cast(0 as bigint) as rt, cast(0 as bigint) as oo, cast(0 as bigint) as da, cast(0 as bigint) as fr, cast(null as bigint) as srtt,
    cast(null as bigint) as ho, cast(null as bigint) as hi, cast(null as bigint) as la, cast(0 as bigint) as run, cast(null as bigint) as pseq, cast(null as bigint) as pus,
    cast(null as struct(state varchar, created_us bigint, last_us bigint, terminal_us bigint, closed_us bigint, close_reason varchar, direction boolean, bs bigint, br bigint, ps bigint, pr bigint, rt bigint, oo bigint, da bigint, fr bigint, srtt bigint)) as done
  from q
  union all
  select protocol, local_ip, local_port, remote_ip, remote_port, n, not dropped, tomb1, st, case when fresh then us else created_us end, case when fresh then us else greatest(last_us, us) end, case when st in ('TIME_WAIT', 'CLOSED') then coalesce(case when not fresh then terminal_us end, us) end,
    case when fresh then case when protocol <> 'TCP' then null when st = 'SYN_SENT' then true when st = 'SYN_RECV' then false when syn and a then not o end else direction end,
    case when fresh then 0 else bs end + case when o then len else 0 end, case when fresh then 0 else br end + case when o then 0 else len end, case when fresh then 0 else ps end + case when o then 1 else 0 end, case when fresh then 0 else pr end + case when o then 0 else 1 end,
    case when fresh then 0 else rt + case when retr then 1 else 0 end end, case when fresh then 0 else oo + case when late_in then 1 else 0 end end, case when fresh then 0 else da + case when dup then 1 else 0 end end, case when fresh then 0 else fr + case when dup and run = 2 then 1 else 0 end end,
    case when fresh then null when timed then coalesce((srtt * 7 + us - pus) // 8, us - pus) else srtt end,
    case when fresh then null when seg and o and used > 0 and not retr then e else ho end, case when fresh then null when seg and not o and used > 0 and not late_in then e else hi end,
    case when fresh then null when acks and (la is null or newer) then ackno else la end, case when fresh then 0 when dup then run + 1 when acks and newer then 0 else run end,
    case when fresh or retr or timed then null when probes then e else pseq end, case when fresh then null when probes then us else pus end, done
  from (
    select *, seg and o and used > 0 and not retr and (pseq is null or us - pus > 10000000) as probes, coalesce(acks and la is not null and ackno = la, false) as dup, coalesce(acks and ackno <> la and ((la - ackno) % 4294967296 + 4294967296) % 4294967296 >= 2147483648, false) as newer,
      case when protocol <> 'TCP' then protocol when rst then 'CLOSED'
        when was = 'TCP_UNKNOWN' and syn and not a and not fin then case when o then 'SYN_SENT' else 'SYN_RECV' end when was = 'TCP_UNKNOWN' and not syn and a then 'ESTABLISHED'
        when was = 'SYN_SENT' and syn and a and not fin and not o then 'ESTABLISHED' when was = 'SYN_RECV' and not syn and a and not fin and o then 'ESTABLISHED'
        when was = 'ESTABLISHED' and not syn and fin then case when o then 'FIN_WAIT1' else 'CLOSE_WAIT' end
        when was = 'FIN_WAIT1' and not syn and not o and fin then 'CLOSING' when was = 'FIN_WAIT1' and not syn and a and not o then 'FIN_WAIT2'
        when was = 'FIN_WAIT2' and not syn and fin and not o then 'TIME_WAIT' when was = 'CLOSE_WAIT' and not syn and fin and o then 'LAST_ACK'
        when was = 'LAST_ACK' and not syn and a and not fin and not o then 'CLOSED' when was = 'CLOSING' and not syn and a and not fin and not o then 'TIME_WAIT' else was end as st
    from (
      select *, not live1 as fresh, case when live1 then state else 'TCP_UNKNOWN' end as was, seg and o and used > 0 and coalesce(((ho - e) % 4294967296 + 4294967296) % 4294967296 < 2147483648, false) as retr,
        seg and not o and used > 0 and coalesce(((hi - e) % 4294967296 + 4294967296) % 4294967296 < 2147483648, false) as late_in, seg and not o and a and coalesce(((ackno - pseq) % 4294967296 + 4294967296) % 4294967296 < 2147483648, false) as timed, seg and not o and a and used = 0 as acks
      from (
        select *, live1 and protocol = 'TCP' as seg, pay + cast(syn as int) + cast(fin as int) as used, (seq + pay + cast(syn as int) + cast(fin as int)) % 4294967296 as e,
          coalesce(not live1 and protocol = 'TCP' and not syn and (fin or rst or (a and pay = 0)) and us - tomb1 between 0 and 30000000, false) as dropped
        from (
          select *, live and why is null as live1, case when why is null then tomb when state in ('TIME_WAIT', 'CLOSED') then closed_at end as tomb1,
            case when why is not null then row(state, created_us, last_us, terminal_us, closed_at, why, direction, bs, br, ps, pr, rt, oo, da, fr, srtt) end as done
          from (
            select * exclude (stop), case when live and us > stop then 'timeout' when live and protocol = 'TCP' and syn and state in ('TIME_WAIT', 'CLOSED', 'FIN_WAIT1', 'FIN_WAIT2', 'CLOSE_WAIT', 'LAST_ACK', 'CLOSING') then 'new_generation' end as why, case when us > stop then stop else us end as closed_at
            from (
              select f.* exclude (n, done), q.* exclude ({KEYS}), coalesce(f.terminal_us, f.last_us) + 1000000 * case when f.protocol = 'ICMP' then 10 when f.protocol = 'UDP' then case q.app when 'DNS' then 30 when 'NTP' then 30 when 'HTTP' then 600 when 'HTTPS' then 600 when 'SSH' then 1800 else 60 end
                else case f.state when 'ESTABLISHED' then case q.app when 'SSH' then 1800 when 'HTTP' then 600 when 'HTTPS' then 600 else 300 end when 'TIME_WAIT' then 30 when 'CLOSING' then 30 when 'CLOSED' then 15 when 'TCP_UNKNOWN' then 120 else 60 end end as stop
              from f join q on q.protocol = f.protocol and q.local_ip = f.local_ip and q.local_port = f.local_port and q.remote_ip = f.remote_ip and q.remote_port = f.remote_port and q.n = f.n + 1)))))))
select {KEYS}, done.state as state, done.created_us as created_us, done.last_us as last_us, done.terminal_us as terminal_us, done.closed_us as closed_us, done.close_reason as close_reason, done.direction as direction, done.bs as bytes_sent, done.br as bytes_received, done.ps as packets_sent, done.pr as packets_received, done.rt as retransmits, done.oo as out_of_order, done.da as duplicate_acks, done.fr as fast_retransmits, done.srtt as srtt_us from f where done is not null
union all
select {KEYS}, state, created_us, last_us, terminal_us, null, null, direction, bs, br, ps, pr, rt, oo, da, fr, srtt from (select * from f qualify n = max(n) over (partition by {KEYS})) where live
"""


@query("fl5_generations", GENERATIONS_SQL)
def fl5(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.generations(packets(spark, d, 1_000_000), aggregates.application_of(F.col("remote_port")))


@query("fl20_historic_pool", FLOWS_SQL + f" select {KEYS}, last_us from flows where is_historic order by last_us desc, {KEYS} limit 100")
def fl20(spark: SparkSession, d: str) -> DataFrame:
    return sorts.newest(flows(spark, d).where("is_historic"), "last_us", 100, *FLOW).select(*FLOW, "last_us")


@query("fl21_retained", FLOWS_SQL + f" select {KEYS}, is_historic from flows where not is_historic union all (select {KEYS}, is_historic from flows where is_historic order by last_us desc, {KEYS} limit 50)")
def fl21(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    return rows.where("not is_historic").unionByName(sorts.newest(rows.where("is_historic"), "last_us", 50, *FLOW)).select(*FLOW, "is_historic")


@query("fl23_write_once", FLOWS_SQL + f" select {KEYS}, coalesce(nullif(process_name, 'Unknown'), service_name, process_name) as process from flows")
def fl23(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select(*FLOW, joins.first_known(F.col("process_name"), F.col("service_name")).alias("process"))


# -- joins ----------------------------------------------------------------------


@query("jn1_service", FLOWS_SQL + f" select {KEYS}, service_name from flows")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select(*FLOW, "service_name")


@query("jn2_vendor", """select s_suppkey, lpad(to_hex(s_suppkey * 7919 % 1024), 6, '0') as prefix, p.p_name as vendor from supplier left join (select lpad(to_hex(p_partkey * 31 % 1024), 6, '0') as prefix, min_by(p_name, p_partkey) as p_name from part group by 1) p on lower(p.prefix) = lower(lpad(to_hex(s_suppkey * 7919 % 1024), 6, '0'))""")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    prefix = lambda c: F.lpad(F.hex(c), 6, "0")
    oui = table(spark, d, "part").groupBy(prefix(F.col("p_partkey") * 31 % 1024).alias("prefix")).agg(F.min_by("p_name", "p_partkey").alias("vendor"))
    rows = table(spark, d, "supplier").select("s_suppkey", prefix(F.col("s_suppkey") * 7919 % 1024).alias("prefix"))
    return joins.with_vendor(rows.withColumn("mac", F.concat(F.lower("prefix"), F.lit(":00:00:01"))), "mac", oui).select("s_suppkey", "prefix", "vendor")


@query("jn6_geoip", P + """, r as (select n_nationkey, n_name, (203::bigint << 24) + n_nationkey * 2 + (113 << 8) as lo, (203::bigint << 24) + (113 << 8) + n_nationkey * 2 + 1 as hi from nation),
a as (select distinct remote_ip, (203::bigint << 24) + (113 << 8) + cast(split_part(remote_ip, '.', 4) as bigint) as n from packets)
select remote_ip, n_name as country from a left join r on n between lo and hi""")
def jn6(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "nation").select(F.col("n_name").alias("country"), F.concat(F.lit("203.0.113."), (F.col("n_nationkey") * 2).cast("string"), F.lit("/31")).alias("cidr"))
    ips = packets(spark, d).select("remote_ip").distinct()
    return joins.by_range(ips, "remote_ip", dimensions.cidr_ranges(blocks, "cidr"), ["country"])


@query("jn7_flags", FLOWS_SQL + f" select {KEYS}, cast(split_part(remote_ip, '.', 4) as integer) in (1, 7, 9) as remote_is_gateway from flows")
def jn7(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("203.0.113.1",), ("203.0.113.7",), ("203.0.113.9",)], "ip string")
    return joins.flagged(flows(spark, d), "remote_ip", known, "ip", "remote_is_gateway").select(*FLOW, "remote_is_gateway")


def _sockets(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    rows = packets(spark, d).select("protocol", "local_ip", "local_port", "remote_ip", "remote_port", "user_id").distinct()
    wild = lambda c, w: F.when(u % 4 == 0, F.col(c)).otherwise(w)
    return rows.where(u % 3 != 1).select(
        "protocol",
        F.when(u % 4 < 2, F.when(u % 4 == 0, F.lit("0.0.0.0")).otherwise(F.col("local_ip"))).otherwise("0.0.0.0").alias("local_ip"),
        "local_port",
        wild("remote_ip", F.lit("0.0.0.0")).alias("remote_ip"),
        wild("remote_port", F.lit(0)).cast("int").alias("remote_port"),
        (u + 1000).alias("pid"),
        F.concat(F.lit("p"), u.cast("string")).alias("name"),
    )


SOCKETS_SQL = P + """, base as (select distinct protocol, local_ip, local_port, remote_ip, remote_port, user_id from packets),
s as (select protocol, case when user_id % 4 = 1 then local_ip else '0.0.0.0' end as local_ip, local_port, case when user_id % 4 = 0 then remote_ip else '0.0.0.0' end as remote_ip,
  case when user_id % 4 = 0 then remote_port else 0 end as remote_port, user_id + 1000 as pid, 'p' || user_id as name from base where user_id % 3 <> 1)"""


@query("jn5_relaxed_owner", SOCKETS_SQL + """, o as (
  select b.user_id, s.pid, s.name, case when s.remote_port <> 0 then 1 when s.local_ip <> '0.0.0.0' then 2 else 3 end as quality from base b join s on s.protocol = b.protocol and s.local_port = b.local_port and b.protocol in ('TCP', 'UDP')
  and ((s.local_ip = '0.0.0.0' and s.remote_ip = b.remote_ip and s.remote_port = b.remote_port) or (s.local_ip = b.local_ip and s.remote_ip = '0.0.0.0' and s.remote_port = 0) or (s.local_ip = '0.0.0.0' and s.remote_ip = '0.0.0.0' and s.remote_port = 0)))
select user_id, min(pid) as pid, min_by(name, quality) as name, min(quality) as quality from o group by user_id having count(distinct pid) = 1""")
def jn5(spark: SparkSession, d: str) -> DataFrame:
    rows = packets(spark, d).select(*FLOW, "user_id").distinct()
    return joins.relaxed_owner(rows, _sockets(spark, d), ["user_id"])


@query("jn4_exact_owner", P + f", base as (select distinct {KEYS}, user_id from packets) select {KEYS}, case when user_id % 2 = 0 then user_id + 1000 end as pid from base")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    rows = packets(spark, d).select(*FLOW, "user_id").distinct()
    known = rows.where("user_id % 2 = 0").select(*FLOW, (F.col("user_id") + 1000).alias("pid"), F.lit("p").alias("name"))
    icmp_apart = rows.where("protocol <> 'ICMP'")
    merged = joins.exact_owner(icmp_apart, known.where("protocol <> 'ICMP'")).select(*FLOW, "pid")
    return merged.unionByName(rows.where("protocol = 'ICMP'").select(*FLOW, F.when(F.col("user_id") % 2 == 0, F.col("user_id") + 1000).alias("pid")))


def _as_of_sql(forward: bool) -> str:
    gap = "a.at - f.at" if forward else "f.at - a.at"
    return P + f""", f as (select frame_no as id, us as at, remote_ip from packets where syn), a as (select us as at, remote_ip, 'n' || txid as name from packets where rst)
select f.id, min_by(a.name, ({gap}) * 1000 + cast(substr(a.name, 2) as bigint)) as name from f join a on a.remote_ip = f.remote_ip and {gap} between 0 and 10000000 group by f.id"""


def _as_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = packets(spark, d)
    return p.where("syn").select(F.col("frame_no").alias("id"), F.col("us").alias("at"), "remote_ip"), p.where("rst").select(F.col("us").alias("at"), "remote_ip", F.concat(F.lit("n"), F.col("txid").cast("string")).alias("name"))


@query("jn8_name_before", _as_of_sql(False))
def jn8(spark: SparkSession, d: str) -> DataFrame:
    left, right = _as_of(spark, d)
    return joins.as_of(left, right, "remote_ip", 10 * SECOND).select("id", "name")


@query("jn9_name_after", _as_of_sql(True))
def jn9(spark: SparkSession, d: str) -> DataFrame:
    left, right = _as_of(spark, d)
    return joins.as_of(left, right, "remote_ip", 10 * SECOND, forward=True).select("id", "name")


@query("jn10_attributed", P + """, f as (select frame_no as id, us as at, remote_ip from packets where syn and remote_port <> 53), a as (select us as at, remote_ip, 'n' || txid as name from packets where rst),
b as (select f.id, max_by(a.name, a.at) as name from f join a on a.remote_ip = f.remote_ip and f.at - a.at between 0 and 10000000 group by f.id),
c as (select f.id, min_by(a.name, a.at) as name from f join a on a.remote_ip = f.remote_ip and a.at - f.at between 0 and 10000000 group by f.id)
select f.id, coalesce(b.name, c.name) as hostname from f left join b using (id) left join c using (id)""")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d)
    left = p.where("syn and remote_port <> 53").select(F.col("frame_no").alias("id"), F.col("us").alias("at"), "remote_ip")
    return joins.attribute(left, _as_of(spark, d)[1], "remote_ip").select("id", "hostname")


def _pair_sql(where: str, keys: str, request: str, response: str, age: int, pick: str = "max_by") -> str:
    return P + f""", e as (select *, case when {request} then true when {response} then false end as q from packets where {where}),
m as (select *, lag(q) over w as pq, lag(us) over w as pu from e where q is not null window w as (partition by {keys} order by us, frame_no))
select {keys}, count(*) as matches, cast(sum(us - pu) as bigint) as sum_us, {pick}(us - pu, frame_no) as latency_us from m where not q and pq and us - pu < {age} * 1000000 group by all"""


@query("jn11_handshake_rtt", _pair_sql("protocol = 'TCP'", KEYS, "syn and is_outgoing", "syn and not is_outgoing", 30, "min_by"))
def jn11(spark: SparkSession, d: str) -> DataFrame:
    return latency.handshake(packets(spark, d))


for _n, _name, _where, _kind, _extra in (
    (12, "quic_rtt", "protocol = 'UDP' and remote_port = 443", "quic", []),
    (13, "dns_response", "protocol = 'UDP' and remote_port = 53", "dns", ["txid"]),
    (16, "icmp_echo", "protocol = 'ICMP'", "icmp", ["txid"]),
    (17, "stun_rtt", "protocol = 'UDP' and remote_port = 8080", "stun", ["txid"]),
    (18, "ntp_rtt", "protocol = 'UDP' and remote_port = 123", "ntp", ["txid"]),
):
    _keys = [*FLOW, *_extra]
    query(f"jn{_n}_{_name}", _pair_sql(_where, ", ".join(_keys), "is_outgoing", "not is_outgoing", 30 if _kind == "quic" else 10))(lambda s, d, w=_where, k=_kind, keys=_keys: latency.transactions(packets(s, d), F.expr(w), k, keys))

for _n, _name, _keys in ((14, "llmnr_response", ["local_ip", "local_port", "txid"]), (15, "netbios_response", ["local_ip", "protocol", "txid"])):
    query(f"jn{_n}_{_name}", _pair_sql("protocol = 'UDP'", ", ".join(_keys), "is_outgoing", "not is_outgoing", 10))(lambda s, d, keys=_keys: latency.transactions(packets(s, d), F.expr("protocol = 'UDP'"), "llmnr", keys))


@query("jn19_interval_match", P + """, t as (select l_orderkey * 8 + l_linenumber as line, l_suppkey % 50 as k, (l_orderkey % 200) * 1000000 as first_us, (l_orderkey % 200) * 1000000 + l_linenumber * 500000 as last_us from lineitem),
m as (select frame_no, line, greatest(first_us - us, us - last_us, 0) as dist from packets p join t on t.k = p.user_id % 50 and us between first_us - 2000000 and last_us + 2000000)
select frame_no, min(dist) as distance_us, arg_min(line, dist * 1000000000 + line) as line from m group by 1""")
def jn19(spark: SparkSession, d: str) -> DataFrame:
    first = (F.col("l_orderkey") % 200) * SECOND
    spans = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("line"), (F.col("l_suppkey") % 50).alias("k"), first.alias("first_us"), (first + F.col("l_linenumber") * 500_000).alias("last_us"))
    return joins.interval_match(packets(spark, d).select("frame_no", "us", (F.col("user_id") % 50).alias("k")), spans, ["k"], 2 * SECOND)


def _processes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.expr("c_custkey div 3").alias("ppid"), F.col("c_name").alias("name"))


@query("jn22_lineage", """with recursive p as (select c_custkey as pid, c_custkey // 3 as ppid, c_name as name from customer),
w as (select pid as start, ppid as next, 0 as level, cast([] as varchar[]) as names, [pid] as seen from p union all
  select w.start, p.ppid, w.level + 1, list_prepend(p.name, w.names), list_append(w.seen, p.pid) from w join p on p.pid = w.next and not list_contains(w.seen, p.pid) where w.level < 5)
select start as pid, array_to_string(max_by(names, level) filter (level <= 4), '>') as ancestors, max(level) > 4 as truncated from w group by 1""")
def jn22(spark: SparkSession, d: str) -> DataFrame:
    return joins.lineage(_processes(spark, d)).select("pid", F.array_join(F.transform("ancestors", lambda a: a["name"]), ">").alias("ancestors"), "truncated")


@query("jn23_completed_only", FLOWS_SQL + " select process_name, count(*) as flows from flows where is_historic and process_name is not null and process_name not in (select process_name from flows where not is_historic and process_name is not null and bytes_sent > 100000) group by 1")
def jn23(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).where("process_name is not null")
    return joins.completed_only(rows.where("not is_historic and bytes_sent > 100000"), rows.where("is_historic"), ["process_name"]).groupBy("process_name").agg(F.count(F.lit(1)).alias("flows"))


@query("jn20_k8s_sockets", """select o_orderkey, coalesce(c.c_name, n.n_name) as pod from orders left join customer c on c.c_custkey = o_custkey and c.c_custkey % 2 = 0 left join nation n on n.n_nationkey = o_custkey % 25""")
def jn20(spark: SparkSession, d: str) -> DataFrame:
    by_container = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    by_pod = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).alias("k"))
    return rows.join(by_container, "o_custkey", "left").join(by_pod, "k", "left").select("o_orderkey", F.coalesce("c_name", "n_name").alias("pod"))


@query("jn21_reverse_names", P + " select distinct remote_ip, case when cast(split_part(remote_ip, '.', 4) as integer) % 2 = 0 then 'host' || split_part(remote_ip, '.', 4) || '.example' end as hostname from packets")
def jn21(spark: SparkSession, d: str) -> DataFrame:
    last = F.split_part("remote_ip", F.lit("."), F.lit(4))
    ips = packets(spark, d).select("remote_ip").distinct()
    ptr = ips.where(last.cast("int") % 2 == 0).select("remote_ip", F.concat(F.lit("host"), last, F.lit(".example")).alias("hostname"))
    return ips.join(ptr, "remote_ip", "left")


# -- aggregations -----------------------------------------------------------------


@query("ag1_applications", FLOWS_SQL + """, n as (select count(*) as total from flows), a as (select unnest([0,1,2,3,4,5]) as place, unnest(['HTTPS','QUIC','HTTP','DNS','SSH','Other']) as application),
c as (select case when application in ('HTTPS','QUIC','HTTP','DNS','SSH') then application else 'Other' end as application, count(*) as c from flows group by 1)
select cast(a.place as integer) as place, a.application, coalesce(c.c, 0) as connections, coalesce(c.c, 0) * 100 / greatest(total, 1) as pct from a left join c using (application) cross join n""")
def ag1(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.application_shares(flows(spark, d))


@query("ag2_states", FLOWS_SQL + f" select state, count(*) as connections, list_position({net.TCP_STATES}, state)::integer as place from flows where protocol = 'TCP' and not is_historic group by 1")
def ag2(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.state_histogram(flows(spark, d), net.TCP_STATES)


@query("ag4_process_groups", FLOWS_SQL + """ select coalesce(process_name, '<unknown>') as label, count(*) filter (not is_historic) as active, count(*) filter (is_historic) as historic, count(*) filter (protocol = 'TCP') as tcp, count(*) filter (protocol = 'UDP') as udp,
cast(sum(case when is_historic then 0 else bytes_received end) as bigint) as total_in, cast(sum(case when is_historic then 0 else bytes_sent end) as bigint) as total_out from flows group by 1""")
def ag4(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.process_groups(flows(spark, d))


@query("ag3_process_traffic", FLOWS_SQL + " select coalesce(process_name, '<unknown>') as label, cast(sum(bytes_sent + bytes_received) as bigint) as bytes from flows where not is_historic group by 1")
def ag3(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.process_groups(flows(spark, d)).where("active > 0").select("label", (F.col("total_in") + F.col("total_out")).alias("bytes"))


@query("ag5_counts", FLOWS_SQL + " select count(*) filter (not is_historic) as active, count(*) filter (is_historic) as historic, count(*) filter (protocol = 'TCP') as tcp, count(*) filter (protocol = 'UDP') as udp, count(distinct process_name) as processes from flows")
def ag5(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.connection_counts(flows(spark, d))


@query("ag6_activity", FLOWS_SQL + """, e as (select process_name, remote_ip, remote_port, sum(bytes_sent) as tx, sum(bytes_received) as rx, sum(case when is_historic then 0 else 1 end) as active, count(*) as total from flows group by all)
select process_name, cast(sum(tx) as bigint) as tx, cast(sum(rx) as bigint) as rx, cast(sum(active) as bigint) as active, cast(sum(total) as bigint) as total, least(count(*), 256) as n_destinations, count(*) > 256 as truncated,
max_by(remote_ip || ':' || remote_port, tx * 1000000000 + cast(split_part(remote_ip, '.', 4) as bigint) * 100000 + remote_port) as top_tx, max_by(remote_ip || ':' || remote_port, rx * 1000000000 + cast(split_part(remote_ip, '.', 4) as bigint) * 100000 + remote_port) as top_rx from e group by process_name""")
def ag6(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.activity(flows(spark, d))


@query("ag7_overflow", FLOWS_SQL + """, k as (select process_name from flows group by 1 order by process_name nulls first limit 4)
select case when process_name in (select process_name from k where process_name is not null) then process_name when process_name is null then 'Unknown' else 'Other' end as process, cast(sum(bytes_sent) as bigint) as tx, cast(sum(bytes_received) as bigint) as rx, count(*) as connections from flows group by 1""")
def ag7(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.with_overflow(flows(spark, d), 4)


@query("ag8_shares", FLOWS_SQL + ", g as (select coalesce(process_name, '<unknown>') as label, sum(bytes_sent) as tx from flows group by 1) select label, cast(tx as bigint) as tx, round(tx / (select sum(tx) from g) * 100, 6) as share_pct from g")
def ag8(spark: SparkSession, d: str) -> DataFrame:
    g = flows(spark, d).groupBy(F.coalesce("process_name", F.lit("<unknown>")).alias("label")).agg(F.sum("bytes_sent").alias("tx"))
    return aggregates.shares(g, "tx").withColumn("share_pct", F.round("share_pct", 6))


@query("ag9_neighbours", P + """, l as (select us, frame_no, local_ip as ip, '02:00:00:00:00:' || lpad(to_hex(txid % 16), 2, '0') as mac from packets union all select us, frame_no, remote_ip, '02:00:00:00:01:' || lpad(to_hex(txid % 16), 2, '0') from packets where not is_outgoing)
select ip, lower(max_by(mac, frame_no)) as mac, max(us) as us from l group by ip""")
def ag9(spark: SparkSession, d: str) -> DataFrame:
    mac = lambda n: F.lower(F.concat(F.lit(f"02:00:00:00:{n}:"), F.lpad(F.hex(F.col("txid") % 16), 2, "0")))
    arp = packets(spark, d).select("us", "frame_no", F.when(F.col("is_outgoing"), "request").otherwise("reply").alias("op"), F.col("local_ip").alias("sender_ip"), mac("00").alias("sender_mac"), F.col("remote_ip").alias("target_ip"), mac("01").alias("target_mac"))
    return aggregates.neighbours(arp)


@query("ag10_average_rtt", P + """, s as (select *, row_number() over (partition by user_id order by us desc, frame_no desc) as k, max(us) over (partition by user_id) as newest from packets)
select user_id, round(avg(packet_len), 6) as mean, count(*) as samples from s where k <= 100 and us >= newest - 10000000 group by 1""")
def ag10(spark: SparkSession, d: str) -> DataFrame:
    return windows.recent_average(packets(spark, d), ["user_id"], "us", "packet_len", 10)


@query("ag12_unique_connections", P + f" select count(distinct ({KEYS})) as connections from packets")
def ag12(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).agg(F.count_distinct(F.struct(*FLOW)).alias("connections"))


@query("ag13_coverage", P + ", t as (select us // 1000000 as tick, sum(packet_len) as captured, sum(packet_len + txid) as seen from packets group by 1) select tick, round(least(1.0, captured / seen), 6) as coverage from t")
def ag13(spark: SparkSession, d: str) -> DataFrame:
    t = packets(spark, d).groupBy(F.expr("us div 1000000").alias("tick")).agg(F.sum("packet_len").alias("captured"), F.sum(F.col("packet_len") + F.col("txid")).alias("seen"))
    return t.select("tick", F.round(net.coverage(F.col("captured"), F.col("seen")), 6).alias("coverage"))


@query("ag14_counters", P + " select count(*) as packets, cast(sum(packet_len) as bigint) as bytes, count(*) filter (is_outgoing) as sent, count(*) filter (rst) as resets, count(distinct user_id) as flows from packets")
def ag14(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.counters(packets(spark, d))


@query("ag15_grouped_rows", FLOWS_SQL + """ select coalesce(process_name, '<unknown>') as label, 0 as level, 0::bigint as seq, count(*) as n, false as is_last from flows group by 1 union all
select label, 1, row_number() over w, 1, lead(created_us) over w is null from (select *, process_name as label from flows where process_name in ('proc1', 'proc2')) window w as (partition by label order by created_us, local_port)""")
def ag15(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.grouped_rows(flows(spark, d), ["proc1", "proc2"])


@query("ag16_latest", P + ", t as (select us // 1000000 as tick, count(*) as packets from packets group by 1) select max(tick) as tick, max_by(packets, tick) as packets from t")
def ag16(spark: SparkSession, d: str) -> DataFrame:
    t = windows.ticks(packets(spark, d), [])
    return t.agg(F.max("tick").alias("tick"), F.max_by("packets", "tick").alias("packets"))


# -- windows and time series -------------------------------------------------------


@query("wn1_sliding_rate", P + f""", s as (select *, row_number() over (partition by {KEYS} order by us, frame_no) as nth from packets),
r as (select *, count(*) over f as n, us - min(us) over f as span, sum(case when is_outgoing then packet_len else 0 end) over f as o, sum(case when is_outgoing then 0 else packet_len end) over f as i
  from s where nth > 1 window f as (partition by {KEYS} order by us range between 10000000 preceding and current row))
select frame_no, round(case when n < 2 or span < 1000000 then 0.0 else o / (span / 1000000) end, 6) as rate_out, round(case when n < 2 or span < 1000000 then 0.0 else i / (span / 1000000) end, 6) as rate_in from r""")
def wn1(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding_rate(packets(spark, d)).select("frame_no", "rate_out", "rate_in")


@query("wn2_samples", P + f", s as (select *, row_number() over (partition by {KEYS} order by us, frame_no) as nth from packets) select {KEYS}, count(*) as samples from s where nth > 1 group by all")
def wn2(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding_rate(packets(spark, d)).groupBy(*FLOW).agg(F.count(F.lit(1)).alias("samples"))


TICKS = P + ", t as (select process_name, us // 1000000 as tick, sum(case when is_outgoing then packet_len else 0 end) as tx, sum(case when is_outgoing then 0 else packet_len end) as rx, count(*) as packets, count(*) filter (rst) as resets from packets group by all)"


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return windows.ticks(packets(spark, d), ["process_name"])


@query("wn3_smoothed_rate", TICKS.replace("with ", "with recursive ", 1) + """, n as (select process_name, row_number() over (partition by process_name order by tick) as k, cast(tx as double) as raw from t),
v as (select distinct process_name, cast(0 as bigint) as k, cast(0 as double) as y from n
  union all select process_name, k, case when x < 1 then 0 else x end from (select n.process_name, n.k, case when raw >= y then raw when raw = 0 then y * 0.15 else 0.6 * raw + 0.4 * y end as x from v join n on n.process_name is not distinct from v.process_name and n.k = v.k + 1))
select process_name, round(y, 6) as smoothed from v qualify k = max(k) over (partition by process_name)""")
def wn3(spark: SparkSession, d: str) -> DataFrame:
    return windows.smoothed_rates(_ticks(spark, d), ["process_name"], "tx")


@query("wn4_counter_delta", TICKS + " select process_name, tick, cast(greatest(tx - lag(tx, 1, 0) over (partition by process_name order by tick), 0) as bigint) as d_tx from t")
def wn4(spark: SparkSession, d: str) -> DataFrame:
    return windows.counter_deltas(_ticks(spark, d), ["process_name"], ["tx"]).select("process_name", "tick", "d_tx")


@query("wn5_peak_rate", TICKS + ", r as (select *, coalesce(tx / (tick - lag(tick) over (partition by process_name order by tick)), 0.0) as rate from t) select process_name, tick, round(rate, 6) as rate, round(max(rate) over (partition by process_name order by tick rows unbounded preceding), 6) as peak from r")
def wn5(spark: SparkSession, d: str) -> DataFrame:
    return windows.peak_rates(_ticks(spark, d), ["process_name"], "tx").select("process_name", "tick", F.round("rate", 6).alias("rate"), F.round("peak", 6).alias("peak"))


@query("wn6_window_bytes", TICKS + ", c as (select *, sum(tx) over (partition by process_name order by tick rows unbounded preceding) as total from t) select process_name, tick, cast(total - coalesce(last_value(total) over (partition by process_name order by tick range between unbounded preceding and 60 preceding), 0) as bigint) as window_bytes from c")
def wn6(spark: SparkSession, d: str) -> DataFrame:
    r = windows.running(_ticks(spark, d), ["process_name"], ["tx"])
    return windows.bytes_in_window(r, ["process_name"], "total_tx").select("process_name", "tick", "window_bytes")


_W = "over (partition by process_name order by tick rows {} preceding)"
for _name, _col in (("wn7_traffic_smoothing", "tx_smooth"), ("wn8_lifecycle_smoothing", "opened_smooth"), ("wn9_loss", "loss_pct")):
    _sql = {
        "tx_smooth": f"cast(floor(sum(tx) {_W.format(2)} / count(*) {_W.format(2)}) as bigint) as tx_smooth, cast(floor(sum(rx) {_W.format(2)} / count(*) {_W.format(2)}) as bigint) as rx_smooth",
        "opened_smooth": f"cast((sum(packets) {_W.format(2)} + count(*) {_W.format(2)} // 2) // count(*) {_W.format(2)} as bigint) as opened_smooth, cast((sum(resets) {_W.format(9)} + count(*) {_W.format(9)} // 2) // count(*) {_W.format(9)} as bigint) as closed_smooth",
        "loss_pct": "round(resets * 100.0 / packets, 6)::double as loss_pct",
    }[_col]
    _shown = {"tx_smooth": ["tx_smooth", "rx_smooth"], "opened_smooth": ["opened_smooth", "closed_smooth"], "loss_pct": ["loss_pct"]}[_col]
    query(_name, TICKS + f" select process_name, tick, {_sql} from t")(lambda s, d, cols=_shown: windows.traffic_series(_ticks(s, d), ["process_name"]).select("process_name", "tick", *(F.col(c).cast("double").alias(c) if c == "loss_pct" else c for c in cols)))


@query("wn10_health", TICKS + f", h as (select *, count(*) over (partition by process_name) as n, row_number() over (partition by process_name order by tick) as k, avg(packets) {_W.format(2)} as m from t) select process_name, tick, case when n < 3 then cast(packets as double) else round(m, 6) end as health from h where n < 3 or k >= 3")
def wn10(spark: SparkSession, d: str) -> DataFrame:
    return windows.health_average(_ticks(spark, d), ["process_name"], "packets").select("process_name", "tick", "health")


@query("wn11_ceiling", TICKS + ", m as (select process_name, tick, greatest(max(tx) over (partition by process_name order by tick rows 119 preceding), 1024) as x from t) select process_name, tick, cast(pow(2, length(bin(cast(x as bigint) - 1))) as bigint) as ceiling from m")
def wn11(spark: SparkSession, d: str) -> DataFrame:
    return windows.ceilings(_ticks(spark, d), ["process_name"], "tx").select("process_name", "tick", "ceiling")


@query("wn12_ring", TICKS + ", r as (select *, row_number() over (partition by process_name order by tick desc) as age from t) select process_name, tick, cast(tx as bigint) as tx from r where age <= 120")
def wn12(spark: SparkSession, d: str) -> DataFrame:
    return windows.last_samples(_ticks(spark, d), ["process_name"]).select("process_name", "tick", "tx")


@query("wn13_sparkline", TICKS + ", r as (select *, row_number() over (partition by process_name order by tick desc) as age from t) select process_name, array_to_string(list(packets order by tick), ',') as line from r where age <= 10 group by 1")
def wn13(spark: SparkSession, d: str) -> DataFrame:
    return windows.sparkline(_ticks(spark, d), ["process_name"], "packets").select("process_name", F.array_join(F.col("line").cast("array<string>"), ",").alias("line"))


@query("wn14_per_second", TICKS + ", r as (select *, (tick - lag(tick) over (partition by process_name order by tick)) * 0.5 as s from t) select process_name, tick, cast(case when s is null or s < 0.25 then 0 else round(tx / s) end as bigint) as per_second from r")
def wn14(spark: SparkSession, d: str) -> DataFrame:
    return windows.tick_rates(_ticks(spark, d), ["process_name"], "tx", 0.5).select("process_name", "tick", "per_second")


@query("wn15_connection_history", P + f", t as (select {KEYS}, us // 1000000 as tick, sum(packet_len) as bytes from packets group by all), r as (select *, row_number() over (partition by {KEYS} order by tick desc) as age from t) select {KEYS}, count(*) as samples, cast(sum(bytes) as bigint) as bytes from r where age <= 120 group by all")
def wn15(spark: SparkSession, d: str) -> DataFrame:
    kept = windows.last_samples(windows.ticks(packets(spark, d), FLOW), FLOW)
    return kept.groupBy(*FLOW).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("tx") + F.col("rx")).alias("bytes"))


@query("wn16_interface_rate", TICKS + ", c as (select *, sum(tx) over (partition by process_name order by tick rows unbounded preceding) as total from t) select process_name, tick, cast(coalesce(floor(greatest(total - lag(total, 1, 0) over w, 0) / (tick - lag(tick) over w)), 0) as bigint) as rate from c window w as (partition by process_name order by tick)")
def wn16(spark: SparkSession, d: str) -> DataFrame:
    r = windows.running(_ticks(spark, d), ["process_name"], ["tx"])
    return windows.interface_rates(r, ["process_name"], "total_tx").select("process_name", "tick", "rate")


@query("wn17_mini_wave", TICKS + f""", w as (select process_name, tick, floor(sum(tx) {_W.format(3)} / count(*) {_W.format(3)}) as wave, row_number() over (partition by process_name order by tick desc) as age from t),
l as (select process_name, list_sort(list(wave)) as w from w where age <= 120 group by 1) select process_name, cast(pow(2, length(bin(cast(greatest(w[cast(ceil(len(w) * 0.9) as integer)], 1024) as bigint) - 1))) as bigint) as scale from l""")
def wn17(spark: SparkSession, d: str) -> DataFrame:
    return windows.mini_wave(_ticks(spark, d), ["process_name"], "tx")


@query("wn18_newest_snapshot", P + f" select {KEYS}, max(us) as us, max_by(packet_len, frame_no) as packet_len from packets group by all")
def wn18(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.latest_by(packets(spark, d), FLOW, ["us", "frame_no"], "us", "packet_len")


# -- sorts and filters ---------------------------------------------------------------


def _sortable(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).withColumns({"rate_in": F.col("bytes_received").cast("double"), "rate_out": F.col("bytes_sent").cast("double"), "country_code": F.when(F.col("last_txid") % 5 != 0, F.concat(F.lit("C"), (F.col("last_txid") % 5).cast("string"))), "rtt_us": F.col("last_txid")})


_ORDERS = {
    "created": "created_us", "bandwidth": "case when is_historic then 0 else bytes_sent + bytes_received end desc", "process": "coalesce(process_name, '')",
    "remote": "cast(split_part(remote_ip, '.', 4) as integer), remote_port", "local": "cast(split_part(local_ip, '.', 4) as integer), local_port",
    "application": "application nulls first, list_position(['TCP','UDP','ICMP','IGMP','ARP'], protocol)", "service": "coalesce(service_name, '')", "state": "state", "rtt": "last_txid desc", "location": "case when last_txid % 5 <> 0 then 'C' || (last_txid % 5) else '' end",
}
for _order, _by in _ORDERS.items():
    query(f"so1_by_{_order}", FLOWS_SQL + f" select {KEYS}, row_number() over (order by {_by}, created_us, {KEYS}) as position from flows")(lambda s, d, o=_order: sorts.connection_positions(_sortable(s, d), o).select(*FLOW, "position"))


@query("so3_activity_order", FLOWS_SQL + ", g as (select process_name, null::bigint as pid, sum(bytes_sent) as tx from flows group by 1) select process_name, cast(tx as bigint) as tx, row_number() over (order by tx desc, process_name nulls first) as position from g")
def so3(spark: SparkSession, d: str) -> DataFrame:
    g = flows(spark, d).groupBy("process_name").agg(F.sum("bytes_sent").alias("tx")).withColumn("pid", F.lit(None).cast("long"))
    return sorts.ranked(g, *sorts.activity_keys("tx")).select("process_name", "tx", "position")


@query("so5_top_five", FLOWS_SQL + " select coalesce(process_name, '<unknown>') as label, cast(sum(bytes_sent) as bigint) as tx from flows where not is_historic group by 1 having sum(bytes_sent) > 0 order by tx desc, label limit 5")
def so5(spark: SparkSession, d: str) -> DataFrame:
    g = aggregates.process_groups(flows(spark, d)).where("total_out > 0").select("label", F.col("total_out").alias("tx"))
    return sorts.top(g, 5, F.desc("tx"), F.asc("label"))


@query("so7_top_ten", with_connections_sql() + f" select {KEYS}, bytes_sent + bytes_received as bytes from connections order by bytes desc, {KEYS} limit 10")
def so7(spark: SparkSession, d: str) -> DataFrame:
    rows = connections(packets(spark, d)).select(*FLOW, (F.col("bytes_sent") + F.col("bytes_received")).alias("bytes"))
    return sorts.top(rows, 10, F.desc("bytes"), *map(F.asc, FLOW))


@query("so8_first_packets", P + " select frame_no, us from packets order by frame_no limit 100")
def so8(spark: SparkSession, d: str) -> DataFrame:
    return sorts.top(packets(spark, d).select("frame_no", "us"), 100, F.asc("frame_no"))


_FILTERS = {
    "fi4_port": ("port:443", "local_port = 443 or remote_port = 443"),
    "fi4_port_part": ("port:99999", "cast(local_port as varchar) like '%99999%' or cast(remote_port as varchar) like '%99999%'"),
    "fi4_port_regex": ("dport:/^5/", "regexp_matches(cast(remote_port as varchar), '^5')"),
    "fi4_port_empty": ("port:", "true"),
    "fi6_sport": ("sport:4001", "local_port = 4001"),
    "fi7_source": ("src:10.0.0.1", "local_ip like '%10.0.0.1%'"),
    "fi8_protocol": ("proto:tcp", "lower(protocol) like '%tcp%'"),
    "fi8_process": ("process:PROC1 svc:http", "coalesce(lower(process_name) like '%proc1%', false) and coalesce(lower(service_name) like '%http%', false)"),
    "fi8_state": ("state:/^time/", "regexp_matches(state, '(?i)^time')"),
    "fi10_application": ("app:http", "coalesce(lower(application) like '%http%', false)"),
    "fi1_and": ("proto:tcp dport:443 proc2", "lower(protocol) like '%tcp%' and remote_port = 443 and (coalesce(lower(process_name) like '%proc2%', false) or local_ip || ':' || local_port like '%proc2%' or remote_ip || ':' || remote_port like '%proc2%')"),
    "fi2_general": ("203.0.113.4", "local_ip || ':' || local_port like '%203.0.113.4%' or remote_ip || ':' || remote_port like '%203.0.113.4%'"),
    "fi3_bad_regex": ("process:/(/", "coalesce(lower(process_name) like '%/(/%', false)"),
    "fi1_blank": ("   ", "true"),
}
for _name, (_text, _where) in _FILTERS.items():
    query(_name, FLOWS_SQL + f" select {KEYS} from flows where {_where}")(lambda s, d, q=_text: (lambda r: r.where(filters.parse(q, r.columns)).select(*FLOW))(flows(s, d)))


@query("fi14_localhost", with_connections_sql() + f" select {KEYS} from connections where not (local_ip like '127.%' and remote_ip like '127.%')")
def fi14(spark: SparkSession, d: str) -> DataFrame:
    return connections(packets(spark, d)).where(filters.not_localhost()).select(*FLOW)


@query("fi16_historic", FLOWS_SQL + f" select {KEYS} from flows where not is_historic")
def fi16(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).where(filters.live_or_all(False)).select(*FLOW)


@query("fi17_staleness", with_connections_sql() + f" select {KEYS}, case when (200000000 - last_us) / 60000000 >= 0.9 then 'critical' when (200000000 - last_us) / 60000000 >= 0.75 then 'warn' else 'fresh' end as staleness from connections")
def fi17(spark: SparkSession, d: str) -> DataFrame:
    return connections(packets(spark, d)).select(*FLOW, net.staleness(F.lit(200 * SECOND) - F.col("last_us"), F.lit(60 * SECOND)).alias("staleness"))


# -- scalar functions -----------------------------------------------------------------


@query("sf1_scope", """with a as (select event_id, (event_id * 2654435761) % 4294967296 as n from events), o as (select event_id, n // 16777216 as a, n // 65536 % 256 as b, n // 256 % 256 as c, n % 256 as d from a)
select event_id, case when a = 0 and b = 0 and c = 0 and d = 0 then 'UNSPECIFIED' when a = 127 then 'LOOPBACK' when a = 10 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) then 'PRIVATE' when a = 169 and b = 254 then 'LINK-LOCAL'
when a = 100 and b between 64 and 127 then 'CGNAT' when (a = 192 and b = 0 and c = 2) or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) then 'DOCUMENTATION' when a = 198 and b in (18, 19) then 'BENCHMARKING'
when a = 255 and b = 255 and c = 255 and d = 255 then 'BROADCAST' when a between 224 and 239 then 'MULTICAST' when a >= 240 then 'RESERVED' else 'PUBLIC' end as scope from o""")
def sf1(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") * 2654435761) % 4294967296
    return table(spark, d, "events").select("event_id", net.scope(net.ip4_text(n)).alias("scope"))


@query("sf4_message_names", """select event_id, case event_id % 16 when 0 then 'Echo Reply' when 3 then 'Destination Unreachable' when 5 then 'Redirect' when 8 then 'Echo Request' when 11 then 'Time Exceeded' else 'Type ' || event_id % 16 end as icmp,
case event_id % 40 when 17 then 'Membership Query' when 18 then 'Membership Report v1' when 22 then 'Membership Report v2' when 34 then 'Membership Report v3' when 23 then 'Leave Group' else 'Type 0x' || lower(lpad(to_hex(event_id % 40), 2, '0')) end as igmp from events""")
def sf4(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", net.icmp_name(e % 16, F.lit(False)).alias("icmp"), net.igmp_name(e % 40).alias("igmp"))


@query("sf5_dns_names", f"""select event_id, coalesce(map {{{', '.join(f"{k}: '{v}'" for k, v in net.DNS_TYPES.items())}}}[event_id % 300], 'TYPE' || event_id % 300) as qtype, coalesce(['NOERROR','FORMERR','SERVFAIL','NXDOMAIN','NOTIMP','REFUSED'][event_id % 9 + 1], 'RCODE ' || event_id % 9) as rcode from events""")
def sf5(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", net.dns_type(e % 300).alias("qtype"), net.dns_rcode(e % 9).alias("rcode"))


@query("sf13_mac", """select event_id, lower(lpad(to_hex(event_id * 37 % 256), 2, '0')) || ':00:5e:00:53:01' as mac, ((event_id * 37 % 256) & 2) = 2 as is_local, ((event_id * 37 % 256) & 1) = 0 as is_unicast from events""")
def sf13(spark: SparkSession, d: str) -> DataFrame:
    raw = F.unhex(F.concat(F.lpad(F.hex(F.col("event_id") * 37 % 256), 2, "0"), F.lit("005E005301")))
    rows = table(spark, d, "events").select("event_id", net.mac_text(raw).alias("mac"))
    return rows.select("event_id", "mac", net.mac_is_local(F.col("mac")).alias("is_local"), net.mac_is_unicast(F.col("mac")).alias("is_unicast"))


def _scaled_sql(x: str, forms: list[tuple[int, str, str]], small: str) -> str:
    return "case " + " ".join(f"when {x} >= {n} then printf('{f}', {x} / {n}.0) || '{u}'" for n, f, u in forms) + f" else {small} end"


@query("sf14_formats", "with x as (select event_id, (event_id * event_id * 7919) % 5000000000 as n from events) select event_id, " + _scaled_sql("n", [(1 << 30, "%.2f", " GB"), (1 << 20, "%.2f", " MB"), (1 << 10, "%.2f", " KB")], "n || ' B'") + " as bytes, " + _scaled_sql("n", [(1 << 30, "%.2f", " GB/s"), (1 << 20, "%.2f", " MB/s"), (1 << 10, "%.2f", " KB/s")], "case when n > 0 then n || ' B/s' else '-' end") + " as rate from x")
def sf14(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") * F.col("event_id") * 7919) % 5000000000
    return table(spark, d, "events").select("event_id", net.format_bytes(n).alias("bytes"), net.format_rate(n).alias("rate"))


@query("sf15_shortened", "select c_custkey, case when length(c_name) <= 10 then c_name else substr(c_name, 1, 9) || '…' end as head, case when length(c_name) <= 10 then c_name else '…' || right(c_name, 9) end as tail from customer")
def sf15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", net.truncate(F.col("c_name"), 10).alias("head"), net.ellipsize_left(F.col("c_name"), 10).alias("tail"))


@query("sf16_labels", with_connections_sql() + f" select {KEYS}, coalesce(process_name, 'Unknown') || ' (' || last_txid || ')' as process, protocol || ':' || local_ip || ':' || local_port || '-' || protocol || ':' || remote_ip || ':' || remote_port as flow from connections")
def sf16(spark: SparkSession, d: str) -> DataFrame:
    end = lambda s: F.concat("protocol", F.lit(":"), net.endpoint(F.col(f"{s}_ip"), F.col(f"{s}_port")))
    return connections(packets(spark, d)).select(*FLOW, net.process_label(F.col("process_name"), F.col("last_txid")).alias("process"), F.concat(end("local"), F.lit("-"), end("remote")).alias("flow"))


@query("sf18_ciphers", f"""with c as (select event_id, [4865, 4866, 4867, 49195, 49199, 52392, 47, 53, 4660][event_id % 9 + 1] as code from events)
select event_id, coalesce(map {{{', '.join(f"{k}: '{v}'" for k, v in net.CIPHERS.items())}}}[code] || ' (0x' || lpad(to_hex(code), 4, '0') || ')', '0x' || lpad(to_hex(code), 4, '0')) as cipher, code in {tuple(net.SECURE_CIPHERS)} as secure from c""")
def sf18(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, [4865, 4866, 4867, 49195, 49199, 52392, 47, 53, 4660])), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", net.cipher_text(code).alias("cipher"), net.cipher_is_secure(code).alias("secure"))


@query("sf19_seq_lt", P + ", n as (select frame_no, seq, lead(seq) over (partition by user_id order by frame_no) as later from packets) select frame_no, ((seq - later) % 4294967296 + 4294967296) % 4294967296 >= 2147483648 as earlier from n where later is not null")
def sf19(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = packets(spark, d).withColumn("later", F.lead("seq").over(Window.partitionBy("user_id").orderBy("frame_no")))
    return rows.where("later is not null").select("frame_no", net.seq_lt(F.col("seq"), F.col("later")).alias("earlier"))


@query("sf24_gauges", "select event_id, case when value < 50 then 'good' when value < 150 then 'fair' else 'poor' end as rtt, case when value / 20 < 1 then 'good' when value / 20 < 5 then 'fair' else 'poor' end as loss from events")
def sf24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", net.rtt_class(F.col("value")).alias("rtt"), net.loss_class(F.col("value") / 20).alias("loss"))


@query("sf26_age", "select event_id, case when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ago' else s // 3600 || 'h ago' end as age from (select event_id, event_id * 13 as s from events)")
def sf26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", net.age_text(F.col("event_id") * 13).alias("age"))


@query("sf29_rates", "select event_id, least(100.0, greatest(0.0, value / 250 * 100)) as pct, case when value >= 100 then value when value = 0 then 15.0 else 0.6 * value + 40.0 end as smoothed from (select event_id, round(value) + 2 as value from events)")
def sf29(spark: SparkSession, d: str) -> DataFrame:
    v = F.round("value") + 2
    return table(spark, d, "events").select("event_id", net.percentage(v, F.lit(250)).alias("pct"), net.smooth(v, F.lit(100.0)).alias("smoothed"))


@query("sf23_comment_value", "select part_key, nullif(trim(regexp_replace(v, '[[:cntrl:][:space:]]', '_', 'g'), '_'), '') as comment from (select p_partkey as part_key, ' ' || p_name || chr(9) as v from part)")
def sf23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), net.comment_value(F.concat(F.lit(" "), "p_name", F.lit("\t"))).alias("comment"))


# -- sources, decoding and sinks ---------------------------------------------------------


@query("sc10_gateways", "select distinct ((s_suppkey * 7) % 256) || '.' || (s_suppkey % 256) || '.0.1' as ip from supplier where s_suppkey % 4 = 3")
def sc10(spark: SparkSession, d: str) -> DataFrame:
    h = lambda c: F.lpad(F.hex(c), 2, "0")
    s = F.col("s_suppkey")
    gateway = F.concat(F.lit("0100"), h(s % 256), h((s * 7) % 256))
    lines = table(spark, d, "supplier").select(F.concat_ws("\t", F.lit("eth0"), F.lit("00000000"), gateway, F.lpad(F.hex(s % 4), 4, "0"), *map(F.lit, "000"), F.lit("00000000")).alias("value"))
    return dimensions.gateways(lines)


@query("sc12_services", "select cast(p_partkey % 500 as integer) as port, case when p_partkey % 2 = 0 then 'tcp' else 'udp' end as protocol, min_by('s' || p_partkey, p_partkey) as name from part where p_partkey % 7 <> 0 group by all")
def sc12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 7 == 0, "# ").otherwise(""), F.lit("s"), k.cast("string"), F.lit("\t"), (k % 500).cast("string"), F.when(k % 2 == 0, "/tcp").otherwise("/udp"), F.lit(" # note"))
    return dimensions.services(table(spark, d, "part").select(k.alias("line_no"), text.alias("value")))


@query("sc13_vendors", "select lower(lpad(to_hex(p_partkey % 400), 6, '0')) as prefix, min_by(p_name, p_partkey) as vendor from part group by 1")
def sc13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return dimensions.vendors(table(spark, d, "part").select(k.alias("line_no"), F.concat(F.lpad(F.hex(k % 400), 6, "0"), F.lit("\t"), "p_name").alias("value")))


@query("sc11_broadcasts", "select distinct '10.' || (c_custkey % 200) || '.255.255' as broadcast from customer")
def sc11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat(F.lit("10."), (F.col("c_custkey") % 200).cast("string"), F.lit(".7.9")).alias("ip"), F.lit(16).alias("prefix"))
    return dimensions.local_addresses(rows).where("broadcast is not null").select("broadcast").distinct()


def _hosts(rows: DataFrame) -> DataFrame:
    """Flows whose local port is beyond the 16 bits of a frame's on further local addresses: port p of 10.0.0.x is port p % 65536 of 10.h.l.x, where h and l are the bytes of p div 65536."""
    more = F.expr("local_port div 65536")
    address = F.concat_ws(".", F.lit("10"), F.expr("local_port div 16777216").cast("string"), (more % 256).cast("string"), F.split_part("local_ip", F.lit("."), F.lit(4)))
    return rows.withColumns({"local_ip": address, "local_port": F.col("local_port") % 65536})


def _unhosted(rows: DataFrame) -> DataFrame:
    """The addresses and ports before _hosts."""
    octet = lambda n: F.split_part("local_ip", F.lit("."), F.lit(n))
    port = F.col("local_port") + (octet(2).cast("int") * 256 + octet(3).cast("int")) * 65536
    return rows.withColumns({"local_ip": F.concat(F.lit("10.0.0."), octet(4)), "local_port": port})


def _local_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _hosts(packets(spark, d)).select(F.col("local_ip").alias("ip")).distinct()


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Ethernet frames of the packet table's TCP and UDP packets, between _hosts."""
    h = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    p = _hosts(packets(spark, d).where("protocol <> 'ICMP'"))
    out, tcp = F.col("is_outgoing"), F.col("protocol") == "TCP"
    addr = lambda a, b: F.when(out, h(net.ip4_number(F.col(a)), 4)).otherwise(h(net.ip4_number(F.col(b)), 4))
    port = lambda a, b: F.when(out, h(F.col(a), 2)).otherwise(h(F.col(b), 2))
    flags = F.col("fin").cast("int") + F.col("syn").cast("int") * 2 + F.col("rst").cast("int") * 4 + F.col("ack_flag").cast("int") * 16
    l4 = F.when(tcp, F.concat(port("local_port", "remote_port"), port("remote_port", "local_port"), h(F.col("seq"), 4), h(F.greatest("ack", F.lit(0)), 4), F.lit("50"), h(flags, 1), F.lit("200000000000"))).otherwise(F.concat(port("local_port", "remote_port"), port("remote_port", "local_port"), F.lit("000C00000"), F.lit("00061626364")))
    size = F.when(tcp, 40).otherwise(20 + 12)
    ip = F.concat(F.lit("4500"), h(size, 2), F.lit("00000000"), F.lit("40"), F.when(tcp, "06").otherwise("11"), F.lit("0000"), addr("local_ip", "remote_ip"), addr("remote_ip", "local_ip"))
    return p.select("frame_no", "us", F.lit(1).alias("linktype"), F.unhex(F.concat(F.lit("020000000001020000000002"), F.lit("0800"), ip, l4)).alias("data"))


@query("pr6_decoded", P + """ select frame_no, protocol, is_outgoing, local_ip, local_port, remote_ip, remote_port, case when protocol = 'TCP' then syn end as syn, case when protocol = 'TCP' then fin end as fin, case when protocol = 'TCP' then seq end as seq from packets where protocol <> 'ICMP'""")
def pr6(spark: SparkSession, d: str) -> DataFrame:
    return _unhosted(decode.packets(_frames(spark, d), _local_hosts(spark, d))).select("frame_no", "protocol", "is_outgoing", "local_ip", "local_port", "remote_ip", "remote_port", "syn", "fin", "seq")


@query("dp1_http", "select page_id, 'GET' as method, regexp_extract(url, '^https?://[^/]+(.*)$', 1) as path, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages where url is not null and regexp_extract(url, '^https?://[^/]+(.+)$', 1) <> ''")
def dp1(spark: SparkSession, d: str) -> DataFrame:
    path, host = F.regexp_extract("url", r"^https?://[^/]+(.*)$", 1), F.regexp_extract("url", r"^https?://([^/]+)", 1)
    text = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: first.example\r\nhost: "), host, F.lit("\r\n\r\nbody"))
    return table(spark, d, "pages").where((path != "") & F.col("url").isNotNull()).select("page_id", decode.http(text).alias("h")).select("page_id", "h.method", "h.path", "h.host")


@query("dp3_hostnames", "select page_id, h, length(h) between 4 and 253 and regexp_matches(h, '^[A-Za-z0-9_-]{1,63}([.][A-Za-z0-9_-]{1,63})+$') and regexp_matches(h, '[A-Za-z]') as valid from (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as h from pages)")
def dp3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("h")).select("page_id", "h", net.valid_hostname(F.col("h")).alias("valid"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Connections with what lines may tell besides."""
    n = F.col("last_txid")
    return flows(spark, d).withColumns(
        {
            "event": F.when(F.col("is_historic"), "connection_closed").otherwise("new_connection"), "pid": F.when(n % 2 == 0, n + 100), "connection_direction": F.when(n % 3 != 0, n % 3 == 1), "dpi_protocol": F.col("application"),
            "dpi_domain": F.when(n % 5 == 0, F.concat(F.lit("h"), n.cast("string"), F.lit(".example"))), "geoip_country_code": F.when(n % 7 == 0, "DE"), "geoip_asn": F.when(n % 7 == 1, n), "remote_addr_kind": F.when(n % 11 == 0, "Broadcast").otherwise("Unicast"), "remote_is_gateway": n % 13 == 0,
        }
    )


def _json_sql(fields: dict[str, str]) -> str:
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":' || {v}""" for k, v in sorted(fields.items())) + ") || '}'"


_quoted = "'\"' || {} || '\"'".format
_TOLD_SQL = {
    "bytes_received": "{}bytes_received{}", "bytes_sent": "{}bytes_sent{}", "destination_ip": _quoted("remote_ip"), "destination_port": "remote_port", "duration_secs": "{}(last_us - created_us) // 1000000{}",
    "event": "case when is_historic then '\"connection_closed\"' else '\"new_connection\"' end", "process_name": _quoted("process_name"), "protocol": _quoted("protocol"), "source_ip": _quoted("local_ip"), "source_port": "local_port",
    "pid": "case when last_txid % 2 = 0 then last_txid + 100 end", "service_name": _quoted("service_name"), "direction": "case last_txid % 3 when 1 then '\"outgoing\"' when 2 then '\"incoming\"' end", "dpi_protocol": _quoted("application"),
    "dpi_domain": "case when last_txid % 5 = 0 then '\"h' || last_txid || '.example\"' end", "geoip_country_code": "case when last_txid % 7 = 0 then '\"DE\"' end", "geoip_asn": "case when last_txid % 7 = 1 then last_txid end",
    "destination_addr_kind": "case when last_txid % 11 = 0 then '\"broadcast\"' end", "destination_is_gateway": "case when last_txid % 13 = 0 then 'true' end",
}
_TOLD_SQL = {k: v.format("case when is_historic then ", " end") if v.startswith("{}") else v for k, v in _TOLD_SQL.items()}
_time = "'{{\"secs_since_epoch\":' || ({0} // 1000000) || ',\"nanos_since_epoch\":' || ({0} % 1000000 * 1000) || '}}'".format
_SIDECAR_SQL = {
    "bytes_received": "bytes_received", "bytes_sent": "bytes_sent", "first_seen": _time("created_us"), "last_seen": _time("last_us"), "local_addr": _quoted("local_ip || ':' || local_port"), "remote_addr": _quoted("remote_ip || ':' || remote_port"),
    "process_name": f"coalesce({_quoted('process_name')}, 'null')", "pid": "coalesce(case when last_txid % 2 = 0 then last_txid + 100 end::varchar, 'null')", "protocol": _quoted("protocol"), "state": _quoted("state"),
    "geoip_country_code": _TOLD_SQL["geoip_country_code"], "geoip_asn": _TOLD_SQL["geoip_asn"], "remote_addr_kind": _TOLD_SQL["destination_addr_kind"], "remote_is_gateway": _TOLD_SQL["destination_is_gateway"],
}


@query("sk1_event_lines", FLOWS_SQL + f" select {_json_sql(_TOLD_SQL)} as value from flows")
def sk1(spark: SparkSession, d: str) -> DataFrame:
    return sinks.event_lines(_told(spark, d))


@query("sk3_sidecar_lines", FLOWS_SQL + f" select {_json_sql(_SIDECAR_SQL)} as value from flows where is_historic")
def sk3(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sidecar_lines(_told(spark, d).where("is_historic"))


@query("sk6_comments", FLOWS_SQL + f" select {KEYS}, 'flow ' || concat_ws(' ', 'process=' || process_name, 'app=' || application) as comment from flows where process_name is not null or application is not null")
def sk6(spark: SparkSession, d: str) -> DataFrame:
    note = sinks.comment("flow", {"process": F.col("process_name"), "app": F.col("application")})
    return flows(spark, d).select(*FLOW, note.alias("comment")).where("comment is not null")


_COMMENT_SQL = f""", told as (select *, last_txid as n from flows),
notes as (select {KEYS}, concat_ws(' ', 'process=' || process_name, case when n % 2 = 0 then 'pid=' || (n + 100) end, case when n % 4 = 1 then 'uid=' || n % 3 end,
  case when n % 3 = 0 then 'pod=web_' || n end, case when n % 3 = 0 then 'ns=shop' end, case when n % 3 <> 0 then 'direction=' || case when n % 3 = 1 then 'outgoing' else 'incoming' end end, 'app=' || application,
  case when n % 5 = 0 and application is not null then 'sni=h' || n || '.example' end, case when n % 7 = 0 then 'country=DE' end, case when n % 7 = 1 then 'asn=' || n end) as told from told)
select {KEYS}, 'flow ' || told as comment from notes where told <> ''"""


@query("sk6_whole_comments", FLOWS_SQL + _COMMENT_SQL)
def sk6_whole(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("last_txid")
    pod = F.when(n % 3 == 0, F.struct(F.concat(F.lit(" web\t"), n.cast("string")).alias("pod_name"), F.lit("shop").alias("pod_namespace")))
    rows = _told(spark, d).withColumns({"process_uid": F.when(n % 4 == 1, n % 3), "kubernetes": pod})
    return rows.select(*FLOW, sinks.connection_comment(rows).alias("comment")).where("comment is not null")


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """Packets with the columns of a report."""
    n, end = F.col("txid"), lambda s: F.concat_ws(":", f"{s}_ip", F.col(f"{s}_port").cast("string"))
    city = F.when(n % 3 == 0, F.concat(F.lit("Town on the Hill "), n.cast("string"))).when(n % 3 == 1, "Ulm")
    return packets(spark, d).select(
        F.col("frame_no").alias("frame"), (F.col("us") / 1e6).alias("time"), F.col("protocol").alias("proto"), end("local").alias("src"), end("remote").alias("dst"), F.when(n % 2 == 0, "DE").alias("country"), city.alias("city"),
        F.lit(None).cast("string").alias("postal_code"), (n % 5).alias("asn"), F.when(n % 5 > 0, F.concat(F.lit("Net "), (n % 5).cast("string"))).alias("as_org"), (n % 4).alias("pid"), F.col("process_name").alias("process"),
    )


_REPORTED_SQL = P + """, told as (select frame_no as frame, us / 1e6 as time, protocol as proto, local_ip || ':' || local_port as src, remote_ip || ':' || remote_port as dst, case when txid % 2 = 0 then 'DE' end as country,
  case txid % 3 when 0 then 'Town on the Hill ' || txid when 1 then 'Ulm' end as city, txid % 5 as asn, txid % 4 as pid, process_name as process from packets)"""


@query("sk9_tab_lines", _REPORTED_SQL + r""" select frame, concat_ws(chr(9), frame::varchar, printf('%.6f', time), proto, src, dst, coalesce(country, ''), coalesce(city, ''), '', case when asn > 0 then asn::varchar else '' end, case when asn > 0 then 'Net ' || asn else '' end,
  case when pid > 0 then pid::varchar else '' end, coalesce(process, '')) as value from told""")
def sk9_tab(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tab_lines(_reported(spark, d))


@query("sk9_table_lines", _REPORTED_SQL + """ select frame, printf('%6s %-5s %-22s %-22s %-4s %-15s %8s %7s %-15s', frame::varchar, proto, src[1:22], dst[1:22], coalesce(country, '-'), coalesce(case when length(city) > 15 then city[1:12] || '...' else city end, '-'),
  case when asn > 0 then 'AS' || asn else '-' end, case when pid > 0 then pid::varchar else '-' end, coalesce(process, '-')) as value from told""")
def sk9_table(spark: SparkSession, d: str) -> DataFrame:
    return sinks.table_lines(_reported(spark, d))


@query("sk10_unique_connections", P + f", turned as (select protocol, least(local_ip || ':' || local_port, remote_ip || ':' || remote_port) as a, greatest(local_ip || ':' || local_port, remote_ip || ':' || remote_port) as b, us // 10000000 as first_us, txid % 2 as pid from packets) select count(*) as connections from (select distinct * from turned)")
def sk10_unique(spark: SparkSession, d: str) -> DataFrame:
    ends = [F.concat_ws(":", f"{s}_ip", F.col(f"{s}_port").cast("string")) for s in ("local", "remote")]
    out = F.col("is_outgoing")
    lines = packets(spark, d).select(F.when(out, ends[0]).otherwise(ends[1]).alias("src"), F.when(out, ends[1]).otherwise(ends[0]).alias("dst"), "protocol", F.expr("us div 10000000").alias("first_us"), (F.col("txid") % 2).alias("pid"))
    return sinks.unique_connections(lines, ["src", "dst", "protocol"])


_READ = P + """, r as (select user_id % 5 as i, frame_no // 100 as ts_us, cast(sum(packet_len) as bigint) as b, count(*) as n, count_if(rst) as e from packets group by all)"""


@query("sc9_counters", _READ + """ select 'eth' || i as interface_name, ts_us, b as rx_bytes, b + 1 as tx_bytes, n as rx_packets, n + 1 as tx_packets, e as rx_errors, e + 1 as tx_errors, 0::bigint as rx_dropped, 1::bigint as tx_dropped, i::bigint as collisions from r where i <> 3 or ts_us % 2 = 0""")
def sc9(spark: SparkSession, d: str) -> DataFrame:
    seen = packets(spark, d).groupBy((F.col("user_id") % 5).alias("i"), F.expr("frame_no div 100").alias("ts_us")).agg(F.sum("packet_len").alias("b"), F.count(F.lit(1)).alias("n"), F.count_if("rst").alias("e"))
    values = [F.col("b"), F.col("b") + 1, F.col("n"), F.col("n") + 1, F.col("e"), F.col("e") + 1, F.lit(0), F.lit(1), F.col("i")]
    text = [F.when((F.col("i") == 3) & (F.col("ts_us") % 2 == 1), "n/a").otherwise(v.cast("string")) if c == "collisions" else v.cast("string") for c, v in zip(dimensions.COUNTERS, values)]
    files = F.explode(F.array(*(F.struct(F.concat(F.lit("/sys/class/net/eth"), F.col("i").cast("string"), F.lit(f"/statistics/{c}")).alias("path"), F.concat(t, F.lit("\n")).alias("value")) for c, t in zip(dimensions.COUNTERS, text))))
    return dimensions.counters(seen.select("ts_us", files.alias("f")).select("ts_us", "f.*"))


@query("sk10_report", P + " select coalesce(process_name, '<none>') as process, count(*) as packets, cast(sum(packet_len) as bigint) as bytes from packets group by 1")
def sk10(spark: SparkSession, d: str) -> DataFrame:
    return sinks.report(packets(spark, d))


@query("sk9_totals", P + " select count(*) as packets, count(process_name) as attributed, round(count(process_name) * 100 / count(*), 6) as attributed_pct from packets")
def sk9(spark: SparkSession, d: str) -> DataFrame:
    return sinks.totals(packets(spark, d))


@query("st5_tumbling", P + " select 1704067200000000 + us // 10000000 * 10000000 as start_us, protocol, cast(sum(case when is_outgoing then packet_len else 0 end) as bigint) as tx, cast(sum(case when is_outgoing then 0 else packet_len end) as bigint) as rx, count(*) as packets from packets group by all")
def st5(spark: SparkSession, d: str) -> DataFrame:
    from netquarry.streaming.flows import windowed_traffic

    return windowed_traffic(packets(spark, d))


@query("st4_sliding", P + """, w as (select unnest(range(us // 5000000 * 5000000 - 5000000, us // 5000000 * 5000000 + 1, 5000000)) as s, * from packets)
select 1704067200000000 + s as start_us, protocol, cast(sum(case when is_outgoing then packet_len else 0 end) as bigint) as tx, cast(sum(case when is_outgoing then 0 else packet_len end) as bigint) as rx, count(*) as packets from w group by all""")
def st4(spark: SparkSession, d: str) -> DataFrame:
    from netquarry.streaming.flows import windowed_traffic

    return windowed_traffic(packets(spark, d), "10 seconds", "5 seconds")
