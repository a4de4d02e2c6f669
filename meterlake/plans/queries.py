"""Queries over the driver's tables, each with the SQL that computes the same from ``events`` alone."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import ip
from meterlake.functions.formats import bucket_kind, bucket_number
from meterlake.operators import checks, gy, ingest, metering, records, sessions, sketch
from meterlake.plans import contract
from meterlake.plans.config import Config
from meterlake.plans.metering import Metering
from meterlake.report import documents, prometheus
from meterlake.sources.shared import shared_dir, written

INTERVAL_TICKS, VOLUME = 24, 20_000
CUTTING = Config(report_interval_ns=INTERVAL_TICKS * contract.HOUR_NS, volume_threshold_bytes=VOLUME, start_ns=contract.START_NS, tick_ns=contract.HOUR_NS)
#: From this packet on, sessions are modified, released and installed again in session_modification.
CHANGE_PKT, RETURN_PKT = 400, 700

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Packets and their sessions as SQL sees them.
BASE = f"""
base as (
  select event_id as pkt_no, epoch_us(ts) * 1000 as ts_ns, user_id, event_type, json_extract(props, '$.k')::bigint as k,
         least(1400, round(value * 4)::bigint) as n, {contract.IMSI_BASE} + user_id as user_imsi, {contract.TEID_BASE} + 2 * user_id as ul_teid, 10 * (1 + user_id % 3) as rg
  from events
), m as (
  select *, case event_type when 'view' then ul_teid + 1 when 'signup' then {contract.UNKNOWN_BASE} + user_id when 'error' then 0 else ul_teid end as teid,
         event_type = 'error' as control, case when event_type = 'error' then 0 else 28 + n end as bytes,
         case when event_type = 'purchase' then 1 + k % 5 end as qfi,
         14 + 20 + 8 + 8 + case when event_type = 'error' then 4 when event_type = 'purchase' then 8 + 28 + n else 28 + n end as wire_bytes
  from base
), bound as (
  select *, user_imsi as imsi, case when event_type = 'view' then 'downlink' else 'uplink' end as direction from m where event_type in ('view', 'click', 'purchase')
), bucketed as (
  select *, case when qfi is not null then 2147483648 + qfi else rg end as bucket from bound
), ids as (
  select imsi, bucket, min(pkt_no) as first_pkt, sum(bytes)::bigint as bytes, count(*) as packets from bucketed group by all
  union all
  select distinct user_imsi, rg, -1, 0, 0 from m
), merged as (
  select imsi, bucket, min(first_pkt) as first_pkt, sum(bytes)::bigint as bytes, sum(packets)::bigint as packets from ids group by all
), ranked as (
  select *, least(row_number() over (partition by imsi order by first_pkt), 3) - 1 as slot, count(*) over (partition by imsi) as ids from merged
)
"""


def query(sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"with recursive {BASE} " if base else "") + sql
        return f

    return register


def plan(spark: SparkSession, sf_dir: str, config: Config = Config()) -> Metering:
    found = contract.events(spark, sf_dir)
    return Metering(contract.packets(found), contract.sessions(found), config)


def stored(spark: SparkSession, sf_dir: str, config: Config = CUTTING) -> Metering:
    """plan() with usage by tick written once, for queries that read it more than once."""
    return plan(spark, sf_dir, config).stored()


def charging(spark: SparkSession, sf_dir: str) -> Metering:
    """The plan over the charging messages alone; the counters they report come from the packets."""
    own = stored(spark, sf_dir)
    counters = written(own.counters, "counters")
    other = Metering(contract.charging_packets(counters), own.sessions)
    other.counters = counters
    return other


def mixed(spark: SparkSession, sf_dir: str) -> Metering:
    """The plan over one capture that holds both the tunnels and the charging messages."""
    own = stored(spark, sf_dir)
    messages = written(contract.charging_packets(own.counters), "charging")
    return Metering(own.packets.unionByName(messages), own.sessions, CUTTING).stored()


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


@query("select case when event_type = 'error' then 'gtpu-control' else 'metered' end as outcome, count(*) as frames from m group by 1")
def ingest_outcomes(spark, sf_dir):
    p = plan(spark, sf_dir)
    return ingest.outcomes(p.frames, p.tunnels, p.segments)


@query("""select pkt_no, ts_ns, teid, case when control then 1 else 255 end::bigint as msg_type, control, bytes, wire_bytes::bigint as wire_bytes,
  case when qfi is null then 'unknown' else 'uplink' end as dir, qfi, case when not control then 4 end::bigint as ip_version, case when not control then 17 end::bigint as proto,
  case when control then '-' else '10.45.' || (user_id // 256) || '.' || (user_id % 256) end as src, case when control then '-' else '93.184.216.34' end as dst,
  case when not control then 20000 + (user_id * 7 + k % 4) % 40000 end::bigint as src_port, case when not control then [80, 443, 53][pkt_no % 3 + 1] end::bigint as dst_port from m""")
def meter_events(spark, sf_dir):
    e = plan(spark, sf_dir).events
    return longs(e.select("pkt_no", "ts_ns", "teid", "msg_type", "control", "bytes", "wire_bytes", "dir", "qfi", "ip_version", "proto", contract.subscriber_address(F.col("src_ip")).alias("src"), ip.format_ip(F.col("dst_ip")).alias("dst"), "src_port", "dst_port"))


@query("select 1::bigint as msg_type, 7::bigint as seq, count(*) as packets from m where control having count(*) > 0")
def gtpu_control(spark, sf_dir):
    t = plan(spark, sf_dir).tunnels.where("gtpu_status = 'ok' and gtpu_msg_type <> 255")
    return t.groupBy(F.col("gtpu_msg_type").alias("msg_type"), F.col("gtpu_seq").alias("seq")).agg(F.count("*").alias("packets"))


COUNTERS = """select imsi, sum(case when direction = 'uplink' then bytes else 0 end)::bigint as ul_bytes, sum(case when direction = 'downlink' then bytes else 0 end)::bigint as dl_bytes,
  count(*) filter (direction = 'uplink') as ul_packets, count(*) filter (direction = 'downlink') as dl_packets, arg_max(ts_ns, pkt_no) as last_seen_ns from bound group by imsi"""


@query(COUNTERS)
def subscriber_counters(spark, sf_dir):
    return plan(spark, sf_dir).counters


@query("""select count(*) as events, sum(bytes)::bigint as bytes, count(*) filter (control) as control_pdus, arg_max(ts_ns, pkt_no) as last_event_ns,
  sum(case when event_type in ('click', 'purchase') then bytes else 0 end)::bigint as ul_bytes, sum(case when event_type = 'view' then bytes else 0 end)::bigint as dl_bytes,
  count(*) filter (event_type in ('click', 'purchase')) as ul_packets, count(*) filter (event_type = 'view') as dl_packets,
  count(*) filter (event_type = 'signup') as unknown_teid_events, sum(case when event_type = 'signup' then bytes else 0 end)::bigint as unknown_teid_bytes from m""")
def pipeline_totals(spark, sf_dir):
    p = stored(spark, sf_dir)
    return metering.totals(p.combined, p.attributed)


@query("select count(*) as events, coalesce(sum(bytes), 0)::bigint as bytes from m where event_type = 'signup'")
def unknown_teid(spark, sf_dir):
    return metering.unknown_by_teid(plan(spark, sf_dir).attributed).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@query("select teid, count(*) as events, sum(bytes)::bigint as bytes from m where event_type = 'signup' group by teid")
def unknown_teid_by_teid(spark, sf_dir):
    return metering.unknown_by_teid(plan(spark, sf_dir).attributed)


KIND = "case when bucket >= 2147483648 then 'qfi' else 'rating-group' end as kind, (bucket % 2147483648)::bigint as id"


@query(f"select imsi, {KIND}, slot::bigint as slot, bytes, packets, case when first_pkt = -1 then null else first_pkt end as first_pkt from (select imsi, bucket, slot, bytes, packets, (select min(b.pkt_no) from bucketed b where b.imsi = r.imsi and b.bucket = r.bucket) as first_pkt from ranked r)")
def slot_assignment(spark, sf_dir):
    b = plan(spark, sf_dir).buckets
    return longs(b.select("imsi", bucket_kind(F.col("bucket")).alias("kind"), bucket_number(F.col("bucket")).alias("id"), "slot", "bytes", "packets", "first_pkt"))


@query(f"select imsi, slot, {KIND}, bytes, aggregated from (select imsi, slot::bigint as slot, arg_min(bucket, first_pkt) as bucket, sum(bytes)::bigint as bytes, slot = 2 and max(ids) > 3 as aggregated from ranked group by imsi, slot)")
def bucket_bytes(spark, sf_dir):
    s = metering.slots(plan(spark, sf_dir).buckets)
    return longs(s.select("imsi", "slot", bucket_kind(F.col("bucket")).alias("kind"), bucket_number(F.col("bucket")).alias("id"), "bytes", "aggregated"))


@query("select count(distinct imsi) filter (ids > 3) as aggregated_subscribers, count(distinct imsi) as subscribers from ranked")
def bucket_aggregated_subs(spark, sf_dir):
    per = plan(spark, sf_dir).buckets.groupBy("imsi").agg(F.max("ids").alias("ids"))
    return per.agg(F.count_if(F.col("ids") > 3).alias("aggregated_subscribers"), F.count("*").alias("subscribers"))


@query("select qfi, sum(bytes)::bigint as bytes, count(*) as packets, count(distinct imsi) as subscribers from bound where qfi is not null group by qfi")
def qfi_usage(spark, sf_dir):
    a = plan(spark, sf_dir).attributed.where("has_qfi and imsi is not null")
    per = a.groupBy("qfi", "imsi").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    return longs(per.groupBy("qfi").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("subscribers")))


@query("select rg::bigint as rating_group, sum(bytes)::bigint as bytes, count(*) as packets from bound where qfi is null group by rg")
def rating_group_usage(spark, sf_dir):
    a = plan(spark, sf_dir).attributed.where("not has_qfi and imsi is not null")
    return a.groupBy("rating_group").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


FLOWS = """select '10.45.' || (user_id // 256) || '.' || (user_id % 256) as src, 20000 + (user_id * 7 + k % 4) % 40000 as src_port, [80, 443, 53][pkt_no % 3 + 1]::bigint as dst_port,
  arg_min(teid, pkt_no) as teid, min(imsi) as imsi, arg_min(direction, pkt_no) as direction, sum(bytes)::bigint as bytes, count(*) as packets, arg_max(ts_ns, pkt_no) as last_seen_ns from bound group by 1, 2, 3"""


def flow_columns(df: DataFrame) -> DataFrame:
    return df.select(contract.subscriber_address(F.col("src_ip")).alias("src"), "src_port", "dst_port", "teid", "imsi", "direction", "bytes", "packets", "last_seen_ns")


@query(FLOWS)
def flows(spark, sf_dir):
    return flow_columns(plan(spark, sf_dir).flows)


@query(f"select * from ({FLOWS}) order by bytes desc, src, src_port, dst_port limit 20")
def top_flows(spark, sf_dir):
    return metering.top(flow_columns(plan(spark, sf_dir).flows), 20, "bytes", "src", "src_port", "dst_port")


@query("select flow_bytes::bigint as flow_bytes, packets, flows from (select sum(bytes) as flow_bytes, sum(packets)::bigint as packets, count(*) as flows from (select sum(bytes) as bytes, count(*) as packets from bound group by user_id, k % 4, pkt_no % 3))")
def flow_keys(spark, sf_dir):
    """Grouping by the FNV key gives the same flows as grouping by the tuple, unless keys collide."""
    f = plan(spark, sf_dir).flows.groupBy("flow_key").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    return f.agg(F.sum("bytes").alias("flow_bytes"), F.sum("packets").alias("packets"), F.count("*").alias("flows"))


@query(f"select imsi, ul_bytes + dl_bytes as total_bytes, ul_bytes, dl_bytes from ({COUNTERS}) order by total_bytes desc, imsi limit 20")
def top_subscribers(spark, sf_dir):
    c = plan(spark, sf_dir).counters.withColumn("total_bytes", F.col("ul_bytes") + F.col("dl_bytes"))
    return metering.top(c.select("imsi", "total_bytes", "ul_bytes", "dl_bytes"), 20, "total_bytes", "imsi")


@query(f"select * from ({COUNTERS}) where imsi = {contract.IMSI_BASE} + 3")
def subscriber_lookup(spark, sf_dir):
    return plan(spark, sf_dir).counters.where(F.col("imsi") == contract.IMSI_BASE + 3).limit(1)


@query("select teid, sum(bytes)::bigint as bytes from bound group by teid having sum(bytes) > 0")
def teid_totals(spark, sf_dir):
    p = stored(spark, sf_dir)
    return checks.teid_totals(sessions.subscribers(p.sessions), p.records())


def record_sql(gaps: bool) -> str:
    """The fold over a subscriber's ticks as a recursive query; gaps: a record also ends between its events."""
    early = f"pending > 0 and start + {INTERVAL_TICKS} < t.tick" if gaps else "false"
    return f"""
, ticks as (
  select imsi, (ts_ns - {contract.START_NS} + {contract.HOUR_NS - 1}) // {contract.HOUR_NS} as tick, sum(case when direction = 'uplink' then bytes else 0 end)::bigint as u,
         sum(case when direction = 'downlink' then bytes else 0 end)::bigint as d, row_number() over (partition by imsi order by tick) as rn
  from bound group by imsi, tick
), fold as (
  select imsi, 0::bigint as rn, 0::bigint as start, 0::bigint as pending, 0::bigint as pu, 0::bigint as pd, 0::bigint as tick, null::bigint as gap_end, 0::bigint as gap_start, 0::bigint as gu, 0::bigint as gd,
         null::varchar as reason, 0::bigint as cut_start, 0::bigint as cu, 0::bigint as cd from (select distinct imsi from ticks)
  union all
  select imsi, rn, case when reason is null then start1 else tick end, case when reason is null then p2 else 0 end, case when reason is null then u2 else 0 end, case when reason is null then d2 else 0 end, tick,
         case when gap then start1 end, gap_start, case when gap then pu else 0 end, case when gap then pd else 0 end, reason, start1, u2, d2
  from (
    select *, case when p2 >= {VOLUME} then 'volume' when tick - start1 >= {INTERVAL_TICKS} and p2 > 0 then 'interval' end as reason
    from (
      select f.imsi, t.rn, t.tick, {early} as gap, start as gap_start, pu, pd, case when {early} then start + {INTERVAL_TICKS} else start end as start1,
             case when {early} then 0 else pending end + t.u + t.d as p2, case when {early} then 0 else pu end + t.u as u2, case when {early} then 0 else pd end + t.d as d2
      from fold f join ticks t on t.imsi = f.imsi and t.rn = f.rn + 1
    )
  )
), cuts as (
  select imsi, 'interval' as reason, gap_start as start_tick, gap_end as end_tick, gu as ul_bytes, gd as dl_bytes, rn, 0 as o from fold where gap_end is not null
  union all
  select imsi, reason, cut_start, tick, cu, cd, rn, 1 from fold where reason is not null
  union all
  select imsi, 'shutdown', start, tick, pu, pd, rn, 2 from fold f where pending > 0 and rn = (select max(rn) from ticks t where t.imsi = f.imsi)
), cut_records as (
  select imsi, row_number() over (partition by imsi order by rn, o) - 1 as seq, reason, start_tick, end_tick, ul_bytes, dl_bytes from cuts
)
"""


@query(record_sql(True) + "select * from cut_records")
def usage_records_tick(spark, sf_dir):
    return stored(spark, sf_dir).records(contract.START_NS).select("imsi", "seq", "reason", "start_tick", "end_tick", "ul_bytes", "dl_bytes")


@query(record_sql(False) + "select * from cut_records")
def usage_records_event(spark, sf_dir):
    return stored(spark, sf_dir).records(contract.START_NS, gaps=False).select("imsi", "seq", "reason", "start_tick", "end_tick", "ul_bytes", "dl_bytes")


AT_CUT = """, at_cut as (
  select c.imsi, c.seq, r.slot, sum(b.bytes)::bigint as bytes from cut_records c join bucketed b on b.imsi = c.imsi
    and (b.ts_ns - %d + %d) // %d > case when c.seq = 0 then -1 else (select p.end_tick from cut_records p where p.imsi = c.imsi and p.seq = c.seq - 1) end
    and (b.ts_ns - %d + %d) // %d <= c.end_tick
  join ranked r on r.imsi = b.imsi and r.bucket = b.bucket group by all
)""" % ((contract.START_NS, contract.HOUR_NS - 1, contract.HOUR_NS) * 2)


@query(record_sql(True) + AT_CUT + f""", packed as (
  select c.imsi, c.seq, sum(case when direction = 'uplink' then 1 else 0 end)::bigint as up, sum(case when direction = 'downlink' then 1 else 0 end)::bigint as dp from cut_records c join bound b on b.imsi = c.imsi
    and (b.ts_ns - {contract.START_NS} + {contract.HOUR_NS - 1}) // {contract.HOUR_NS} > case when c.seq = 0 then -1 else (select p.end_tick from cut_records p where p.imsi = c.imsi and p.seq = c.seq - 1) end
    and (b.ts_ns - {contract.START_NS} + {contract.HOUR_NS - 1}) // {contract.HOUR_NS} <= c.end_tick group by all
), seen as (
  select r.imsi, r.bucket, r.slot, r.first_pkt, case when r.first_pkt = -1 then 0 else (select min((b.ts_ns - {contract.START_NS} + {contract.HOUR_NS - 1}) // {contract.HOUR_NS}) from bucketed b where b.imsi = r.imsi and b.bucket = r.bucket) end as first_tick from ranked r
), named as (
  select c.imsi, c.seq, s.slot, arg_min(s.bucket, s.first_pkt) as bucket, count(*) as known from cut_records c join seen s on s.imsi = c.imsi and s.first_tick <= c.end_tick group by all
), listed as (
  select n.imsi, n.seq, string_agg('{{"kind":"' || case when bucket >= 2147483648 then 'qfi' else 'rating-group' end || '","id":' || bucket % 2147483648 || ',"bytes":' || coalesce(a.bytes, 0) || ',"aggregate":' || (n.slot = 2 and known > 1) || '}}', ',' order by n.slot) as buckets
  from named n left join at_cut a on a.imsi = n.imsi and a.seq = n.seq and a.slot = n.slot group by all
) select '{{"ts":"' || strftime(timestamp '2024-01-01' + to_hours(c.end_tick), '%Y-%m-%dT%H:%M:%S.000Z') || '","imsi":"' || c.imsi || '","sub":' || sub || ',"seq":' || c.seq || ',"reason":"' || reason || '","ul_bytes":' || ul_bytes || ',"dl_bytes":' || dl_bytes
  || ',"ul_pkts":' || up || ',"dl_pkts":' || dp || ',"interval_ns":' || (end_tick - start_tick) * {contract.HOUR_NS} || ',"buckets":[' || buckets || ']}}' as value
from cut_records c join packed p on p.imsi = c.imsi and p.seq = c.seq join listed l on l.imsi = c.imsi and l.seq = c.seq join (select user_imsi as imsi, dense_rank() over (order by user_id) - 1 as sub from (select distinct user_id, user_imsi from m)) s on s.imsi = c.imsi""")
def usage_record_ndjson(spark, sf_dir):
    p = stored(spark, sf_dir)
    return documents.record_lines(p.records_with_buckets(), sessions.numbered(p.subscribers), contract.START_NS, contract.HOUR_NS)


@query(record_sql(True) + AT_CUT + "select imsi, seq, slot::bigint as slot, bytes from at_cut where bytes > 0")
def usage_record_buckets(spark, sf_dir):
    r = stored(spark, sf_dir).records(contract.START_NS)
    each = r.select("imsi", "seq", F.posexplode(F.array("slot0", "slot1", "slot2")).alias("slot", "bytes"))
    return longs(each.where("bytes > 0"))


@query("select imsi, sum(case when direction = 'uplink' then bytes else 0 end)::bigint as ul_bytes, sum(case when direction = 'downlink' then bytes else 0 end)::bigint as dl_bytes, count(*) filter (direction = 'uplink') as ul_packets, count(*) filter (direction = 'downlink') as dl_packets, true as gapless from bound group by imsi")
def record_rollup_check(spark, sf_dir):
    return checks.rollup(stored(spark, sf_dir).records(contract.START_NS)).drop("records")


@query(record_sql(True) + "select imsi, count(*) as records, true as gapless from cut_records group by imsi")
def sequence_gap_check(spark, sf_dir):
    return checks.rollup(stored(spark, sf_dir).records(contract.START_NS)).select("imsi", "records", "gapless")


@query("select 0::bigint as imsi, ''::varchar as side where false")
def record_mismatches(spark, sf_dir):
    """What the records sum to against the counters, both ways: no rows."""
    p = stored(spark, sf_dir)
    columns = ("imsi", "ul_bytes", "dl_bytes", "ul_packets", "dl_packets")
    return checks.difference(p.counters.select(*columns), checks.rollup(p.records()).select(*columns)).select("imsi", "side")


@query("""select teid, bytes, packets, first_pkt from (select teid, sum(bytes)::bigint as bytes, count(*) as packets, min(pkt_no) as first_pkt from m where event_type = 'signup' group by teid)""")
def learned_subscribers(spark, sf_dir):
    p = stored(spark, sf_dir, dataclasses.replace(CUTTING, learn_unknown_teids=True))
    total = p.counters.select("imsi", (F.col("ul_bytes") + F.col("dl_bytes")).alias("bytes"), (F.col("ul_packets") + F.col("dl_packets")).alias("packets"))
    return p.learned.select("teid", "imsi", "first_pkt").join(total, "imsi").select("teid", "bytes", "packets", "first_pkt")


GY = f", c as ({COUNTERS}), g as (select *, imsi - {contract.IMSI_BASE} as u from c)"


@query(GY + "select u + 1000000000 as pkt_no, last_seen_ns as ts_ns, imsi, true as has_imsi, true as is_request, 3::bigint as cc_request_type, 10 * (1 + u % 3) as rating_group, ul_bytes + (u % 3) * 100 as used_input_octets, dl_bytes as used_output_octets, ul_bytes + dl_bytes + (u % 3) * 100 as used_total_octets, true as has_used, false as has_granted from g")
def gy_events(spark, sf_dir):
    e = charging(spark, sf_dir).gy_events
    return longs(e.select("pkt_no", "ts_ns", "imsi", "has_imsi", "is_request", "cc_request_type", "rating_group", "used_input_octets", "used_output_octets", "used_total_octets", "has_used", "has_granted"))


@query(GY + "select imsi, ul_bytes + dl_bytes + (u % 3) * 100 as gy_reported_octets, 1::bigint as gy_reports, last_seen_ns as gy_last_ns from g")
def gy_totals(spark, sf_dir):
    return longs(charging(spark, sf_dir).gy_totals)


@query(GY + "select imsi, ul_bytes + dl_bytes as metered_octets, ul_bytes + dl_bytes + (u % 3) * 100 as reported_octets, -(u % 3) * 100 as difference, 1::bigint as reports from g")
def gy_crosscheck(spark, sf_dir):
    return longs(charging(spark, sf_dir).crosscheck)


LATENCY = """, v as (select pkt_no, bytes * 37 as v from m where not control), msb as (select pkt_no, v, case when v < 256 then 0 else least(length(ltrim(bin(v), '0')) - 8, 39) end as s from v),
h as (select case when v < 256 then v else s * 256 + ((v >> s) & 255) end as idx, case when v < 256 then v else ((((v >> s) & 255) + 1) << s) - 1 end as edge, pkt_no from msb)"""


def latencies(spark, sf_dir) -> DataFrame:
    return plan(spark, sf_dir).events.where("not control").select("pkt_no", (F.col("bytes") * 37).alias("v"))


@query(LATENCY + "select idx::bigint as idx, edge::bigint as edge, count(*) as n from h group by all")
def latency_histogram(spark, sf_dir):
    return sketch.histogram(latencies(spark, sf_dir), "v")


QUANTILE_SQL = """select q as quantile, min(edge)::bigint as value from (select edge, sum(n) over (order by idx) as seen, sum(n) over () as total from (select idx, edge, count(*) as n from %s group by all)),
  (select unnest([0.5::double, 0.9::double, 0.99::double, 0.999::double, 0.9999::double]) as q) where seen >= floor(q * total + 0.5) group by q"""


@query(LATENCY + QUANTILE_SQL % "h")
def latency_quantiles(spark, sf_dir):
    return sketch.quantiles(sketch.histogram(latencies(spark, sf_dir), "v"))


@query(LATENCY + QUANTILE_SQL % "(select * from h where pkt_no % 8 = 7)")
def sampled_latency(spark, sf_dir):
    return sketch.quantiles(sketch.histogram(sketch.sampled(latencies(spark, sf_dir), 8), "v"))


@query(f"select teid, imsi, d as binding_dir, rg::bigint as rating_group from (select distinct ul_teid as teid, user_imsi as imsi, 'uplink' as d, rg from m union all select distinct ul_teid + 1, user_imsi, 'downlink', rg from m)")
def session_bindings(spark, sf_dir):
    return sessions.bindings(contract.sessions(contract.events(spark, sf_dir)))


def control(found: DataFrame) -> DataFrame:
    """Operations on sessions: of five users one moves its uplink tunnel, one is released, one is released and comes back."""
    s = contract.sessions(found).withColumn("u", F.col("line_no"))
    row = lambda no, pkt, op, ul, rg: F.struct(F.lit(no).alias("no"), F.lit(pkt).cast("long").alias("pkt_no"), F.lit(op).alias("op"), ul.alias("ul_teid"), F.col("dl_teid").alias("dl_teid"), rg.alias("rating_group"))
    first = row(0, 0, "install", F.col("ul_teid"), F.col("rating_group"))
    moved = row(1, CHANGE_PKT, "install", F.lit(contract.UNKNOWN_BASE) + F.col("u"), F.lit(99).cast("long"))
    gone, back = row(1, CHANGE_PKT, "release", F.col("ul_teid"), F.col("rating_group")), row(2, RETURN_PKT, "install", F.col("ul_teid"), F.col("rating_group"))
    steps = F.when(F.col("u") % 5 == 0, F.array(first, moved)).when(F.col("u") % 5 == 1, F.array(first, gone)).when(F.col("u") % 5 == 2, F.array(first, gone, back)).otherwise(F.array(first))
    return s.select("imsi", "u", F.explode(steps).alias("s")).select("imsi", "s.*", (F.col("u") * 4 + F.col("s.no")).alias("ctl_no"))


@query(f"""select imsi, incarnation::bigint as incarnation, sum(case when event_type <> 'view' then bytes else 0 end)::bigint as ul_bytes, sum(case when event_type = 'view' then bytes else 0 end)::bigint as dl_bytes, count(*) as packets
from (select *, user_imsi as imsi, case when user_id % 5 = 2 and pkt_no >= {RETURN_PKT} then 1 else 0 end as incarnation from m where not control and case
  when user_id % 5 = 0 then case when pkt_no < {CHANGE_PKT} then event_type <> 'signup' else event_type in ('view', 'signup') end
  when user_id % 5 = 1 then event_type <> 'signup' and pkt_no < {CHANGE_PKT}
  when user_id % 5 = 2 then event_type <> 'signup' and (pkt_no < {CHANGE_PKT} or pkt_no >= {RETURN_PKT})
  else event_type <> 'signup' end) group by all""")
def session_modification(spark, sf_dir):
    found = contract.events(spark, sf_dir)
    p = plan(spark, sf_dir)
    bound = sessions.bind_at(p.events.where("not control"), sessions.timeline(control(found))).where("imsi is not null")
    bound = bound.withColumn("direction", metering.direction(F.col("binding_dir"), F.col("dir")))
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("bytes")).otherwise(0)).cast("long")
    return bound.groupBy("imsi", "incarnation").agg(side("uplink").alias("ul_bytes"), side("downlink").alias("dl_bytes"), F.count("*").alias("packets"))


@query(f"select user_imsi as imsi, {CHANGE_PKT}::bigint as pkt_no from (select distinct user_id, user_imsi from m) where user_id % 5 in (1, 2)")
def session_releases(spark, sf_dir):
    return sessions.releases(control(contract.events(spark, sf_dir)))


#: Charging frames are of one length each.
CHARGING_BYTES = 14 + 20 + 20 + 20 + 16 + 12 + 12 + 44 + 60
STATE = f"""{record_sql(True)}, c as ({COUNTERS}), told as (
  select count(*) as messages, sum(ul_bytes + dl_bytes + (imsi - {contract.IMSI_BASE}) % 3 * 100)::bigint as octets from c
), state as (
  select count(*) as events, count(*) + messages as frames, sum(wire_bytes)::bigint + {CHARGING_BYTES} * messages as frame_bytes, count(*) filter (not control) as gpdus, count(*) filter (control) as control,
    messages, octets, sum(bytes)::bigint as bytes, sum(bytes) filter (event_type in ('click', 'purchase'))::bigint as ul_bytes, sum(bytes) filter (event_type = 'view')::bigint as dl_bytes,
    count(*) filter (event_type in ('click', 'purchase')) as ul_packets, count(*) filter (event_type = 'view') as dl_packets, count(*) filter (event_type = 'signup') as unknown_events,
    coalesce(sum(bytes) filter (event_type = 'signup'), 0)::bigint as unknown_bytes, (select count(*) from cut_records) as records, count(distinct user_id) as subscribers,
    (select count(*) from (select distinct user_id, k % 4, pkt_no % 3 from bound)) as flows from m, told group by messages, octets
)"""
# each counter and gauge with the column of STATE that it is, or 0
SERIES = {
    "ingest_frames_total": "frames", "ingest_frame_bytes_total": "frame_bytes", "ingest_gpdus_total": "gpdus", "ingest_gtpu_control_total": "control", "ingest_parse_errors_total": "0",
    "ingest_inner_parse_errors_total": "0", "ingest_not_our_traffic_total": "0", "ingest_events_pushed_total": "events", "ingest_events_dropped_total": "0", "diameter_messages_total": "messages",
    "diameter_parse_errors_total": "0", "meter_events_total": "events", "meter_bytes_total": "bytes", 'meter_direction_bytes_total{direction="uplink"}': "ul_bytes",
    'meter_direction_bytes_total{direction="downlink"}': "dl_bytes", 'meter_direction_packets_total{direction="uplink"}': "ul_packets", 'meter_direction_packets_total{direction="downlink"}': "dl_packets",
    "teid_bind_failures_total": "0", "meter_unknown_teid_events_total": "unknown_events", "meter_unknown_teid_bytes_total": "unknown_bytes", "meter_flow_inserts_total": "flows",
    "meter_flow_evictions_total": "0", "usage_records_emitted_total": "records", "usage_records_dropped_total": "0", "usage_records_written_total": "records", "gy_events_total": "messages",
    "gy_reported_octets_total": "octets", "subscribers_active": "subscribers", "flows_active": "flows",
}


@query(STATE + " union all ".join(f"select '{prometheus.PREFIX}{n}' as name, {e}::bigint as value from state" for n, e in SERIES.items()))
def prometheus_series(spark, sf_dir):
    return prometheus.series(mixed(spark, sf_dir).state())


@query(STATE + LATENCY.replace(", v as", ", v as", 1) + """, lat as (select pkt_no, v, edge, idx from h join v using (pkt_no) where pkt_no % 8 = 7), q as (""" + QUANTILE_SQL % "lat" + """)
select '{"ingest":{"frames":' || frames || ',"bytes":' || frame_bytes || ',"gpdus":' || gpdus || ',"control":' || control || ',"parse_errors":0,"events_pushed":' || events
  || ',"events_dropped":0,"diameter_messages":' || messages || '},"meter":{"events":' || events || ',"bytes":' || bytes || ',"ul_bytes":' || ul_bytes || ',"dl_bytes":' || dl_bytes
  || ',"ul_packets":' || ul_packets || ',"dl_packets":' || dl_packets || ',"unknown_teid_events":' || unknown_events || ',"unknown_teid_bytes":' || unknown_bytes
  || ',"teid_bind_failures":0,"flows_active":' || flows || ',"flow_evictions":0,"records_emitted":' || records || ',"records_dropped":0,"records_written":' || records || ',"gy_events":' || messages
  || '},"teid_table":{"size":' || 2 * subscribers || '},"latency_ns":{"count":' || (select count(*) from lat) || ',"min":' || (select min(v) from lat)
  || ',"p50":' || (select value from q where quantile = 0.5) || ',"p90":' || (select value from q where quantile = 0.9) || ',"p99":' || (select value from q where quantile = 0.99)
  || ',"p999":' || (select value from q where quantile = 0.999) || ',"p9999":' || (select value from q where quantile = 0.9999) || ',"max":' || (select max(v) from lat)
  || ',"mean":' || (select round(avg(v), 1) from lat) || '}}' as value from state""")
def stats_document(spark, sf_dir):
    p = mixed(spark, sf_dir)
    return documents.stats_document(p.state(latency=sketch.sampled(latencies(spark, sf_dir), 8), value="v"))


@query("select proto::bigint as proto, version::bigint as ip_version, packets, bytes from (select 17 as proto, 4 as version, count(*) as packets, sum(bytes)::bigint as bytes from m where not control)")
def inner_protocol_mix(spark, sf_dir):
    e = plan(spark, sf_dir).events.where("not control")
    return longs(e.groupBy("proto", "ip_version").agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes")))


@query(f"select (ts_ns // {contract.HOUR_NS}) * 3600 as hour_s, direction, sum(bytes)::bigint as bytes, count(*) as packets from bound group by all")
def hourly_usage_window(spark, sf_dir):
    p = plan(spark, sf_dir)
    ts = F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))
    summed = p.events.where("not control").groupBy("teid", "dir", F.window(ts, "1 hour").alias("w")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("packets"))
    known = summed.join(p.bindings, "teid").withColumn("direction", metering.direction(F.col("binding_dir"), F.col("dir")))
    hourly = known.groupBy("w", "direction").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    return hourly.select(F.unix_seconds("w.start").alias("hour_s"), "direction", "bytes", "packets")


@query("select * from (values ('ok', 4), ('truncated', 2), ('bad-version', 1), ('not-gtpu', 1), ('bad-length', 1), ('bad-ext-header', 1), ('ext-chain-too-long', 1)) t(status, frames)".replace("select *", "select status, frames::bigint as frames"), base=False)
def reject_statuses(spark, sf_dir):
    """Hand-made GTP-U packets, by what the decoder says of them."""
    from meterlake.functions.gtpu import gtpu

    ext = "01000500"
    made = [
        "30FF000000000001", "30FF000400000001" + "00" * 4, "34FF000800000001" + "000000" + "85" + "01100500", "3201000400000000" + "00070000",  # read
        "30FF", "30FF000500000001" + "00" * 4, "50FF000000000001", "20FF000000000001", "32FF000000000001",
        "34FF000800000001" + "00000085" + "00000000", "34FF004800000001" + "00000040" + "01000040" * 17 + ext[:0],
    ]
    df = spark.createDataFrame([(bytes.fromhex(x),) for x in made], "pdu binary")
    return gtpu(df, "pdu").groupBy(F.col("gtpu_status").alias("status")).agg(F.count("*").alias("frames"))


RELEASE_TICK = 300


@query(f"""select imsi, 0::bigint as seq, case when imsi % 5 = 1 then 'release' else 'shutdown' end as reason, sum(case when direction = 'uplink' then bytes else 0 end)::bigint as ul_bytes,
  sum(case when direction = 'downlink' then bytes else 0 end)::bigint as dl_bytes, case when imsi % 5 = 1 then {RELEASE_TICK} else max(tick) end::bigint as end_tick
from (select *, (ts_ns - {contract.START_NS} + {contract.HOUR_NS - 1}) // {contract.HOUR_NS} as tick from bound) where imsi % 5 <> 1 or tick <= {RELEASE_TICK} group by imsi
union all select distinct user_imsi, 0, 'release', 0, 0, {RELEASE_TICK} from m where user_imsi % 5 = 1 and user_imsi not in
  (select imsi from bound where (ts_ns - {contract.START_NS} + {contract.HOUR_NS - 1}) // {contract.HOUR_NS} <= {RELEASE_TICK})""")
def usage_record_releases(spark, sf_dir):
    """A fifth of the subscribers is released at a tick: a last record each, even of nothing; later packets are unknown."""
    p = stored(spark, sf_dir, dataclasses.replace(CUTTING, report_interval_ns=0, volume_threshold_bytes=0))
    gone = sessions.subscribers(p.sessions).where("imsi % 5 = 1").select("imsi", F.lit(RELEASE_TICK).alias("tick"), F.lit("release").alias("op"))
    opened = gone.withColumns({"tick": F.lit(0), "op": F.lit("install")})
    return p.records(control=gone.unionByName(opened)).select("imsi", "seq", "reason", "ul_bytes", "dl_bytes", "end_tick")


@query(f"""select imsi, count(*) as packets, sum(bytes)::bigint as bytes from bound where imsi % 5 = 1 and (ts_ns - {contract.START_NS} + {contract.HOUR_NS - 1}) // {contract.HOUR_NS} > {RELEASE_TICK} group by imsi""")
def usage_after_release(spark, sf_dir):
    """What comes on the tunnels of released subscribers: unknown, and on no record."""
    p = stored(spark, sf_dir)
    gone = sessions.subscribers(p.sessions).where("imsi % 5 = 1").select("imsi", F.lit(RELEASE_TICK).alias("tick"), F.lit("release").alias("op"))
    return records.unbilled(p.ticks(), gone)


@query(record_sql(True) + "select imsi, seq, ul_bytes, dl_bytes from cut_records")
def usage_record_deltas(spark, sf_dir):
    """Cumulative counters at each record, taken apart again."""
    from pyspark.sql import Window

    r = stored(spark, sf_dir).records(contract.START_NS)
    by = Window.partitionBy("imsi").orderBy("seq")
    cumulative = r.select("imsi", "seq", *(F.sum(c).over(by).alias(c) for c in ("ul_bytes", "dl_bytes")))
    return records.deltas(cumulative, "ul_bytes", "dl_bytes")


@query("select count(distinct user_id) as subscribers_active, (select count(*) from (select distinct user_id, k % 4, pkt_no % 3 from bound)) as flows_active from m")
def derived_gauges(spark, sf_dir):
    p = plan(spark, sf_dir)
    return p.subscribers.agg(F.count("*").alias("subscribers_active")).crossJoin(p.flows.agg(F.count("*").alias("flows_active")))  # one row each


SUBS = "select user_imsi as imsi, dense_rank() over (order by user_id) - 1 as sub, ul_teid from (select distinct user_id, user_imsi, ul_teid from m)"


@query(f"""select f.bytes, '{{"teid":' || teid || ',"sub":' || sub || ',"src":"' || src || '","dst":"93.184.216.34","src_port":' || src_port || ',"dst_port":' || dst_port || ',"proto":17,"qfi":' || coalesce(qfi, 0)
  || ',"direction":"' || direction || '","bytes":' || f.bytes || ',"packets":' || packets || '}}' as value
from ({FLOWS.replace("sum(bytes)::bigint as bytes", "sum(bytes)::bigint as bytes, arg_min(coalesce(qfi, 0), pkt_no) as qfi")}) f join ({SUBS}) s on s.imsi = f.imsi""")
def flows_document(spark, sf_dir):
    p = plan(spark, sf_dir)
    return documents.flow_rows(p.flows, sessions.numbered(p.subscribers), contract.subscriber_address).select("bytes", "value")


@query(f""", slotted as (select imsi, slot, arg_min(bucket, first_pkt) as bucket, sum(bytes)::bigint as bytes, max(ids) > 3 as many from ranked group by imsi, slot), texts as (
  select imsi, string_agg('{{"kind":"' || case when bucket >= 2147483648 then 'qfi' else 'rating-group' end || '","id":' || bucket % 2147483648 || ',"bytes":' || bytes || '}}', ',' order by slot) as buckets, bool_or(slot = 2 and many) as aggregated from slotted group by imsi
) select s.imsi, '{{"imsi":"' || s.imsi || '","sub":' || sub || ',"ul_teid":' || ul_teid || ',"dl_teid":' || (ul_teid + 1) || ',"ul_bytes":' || coalesce(ul_bytes, 0) || ',"dl_bytes":' || coalesce(dl_bytes, 0) || ',"ul_packets":' || coalesce(ul_packets, 0)
  || ',"dl_packets":' || coalesce(dl_packets, 0) || ',"gy_reported_octets":' || coalesce(ul_bytes + dl_bytes + (s.imsi - {contract.IMSI_BASE}) % 3 * 100, 0) || ',"gy_reports":' || case when c.imsi is null then 0 else 1 end || ',"buckets":[' || buckets || '],"bucket_aggregated":' || aggregated || '}}' as value
from ({SUBS}) s left join ({COUNTERS}) c on c.imsi = s.imsi join texts t on t.imsi = s.imsi""")
def subscribers_document(spark, sf_dir):
    p = mixed(spark, sf_dir)
    return documents.subscriber_rows(p.counters, sessions.numbered(p.subscribers), metering.slots(p.buckets), p.gy_totals).select("imsi", "value")


LINES = ("# comment", "imsi,ul_teid,dl_teid,rating_group,msisdn,apn", "310150000000001,100,200,10,15551234567,internet", " 310150000000003 , 0x1000,0x2000,5", "not-a-number,1,2,3", "310150000000005", "310150000000006,4294967296,2,3", "0,1,2,3", "7,8,9,bad")


@query("select imsi::bigint as imsi, ul::bigint as ul_teid, dl::bigint as dl_teid, rg::bigint as rating_group, apn from (values (310150000000001, 100, 200, 10, 'internet'), (310150000000003, 4096, 8192, 5, ''), (7, 8, 9, 0, '')) t(imsi, ul, dl, rg, apn)", base=False)
def sessions_csv(spark, sf_dir):
    from meterlake.sources.sessions import parsed

    text = spark.createDataFrame(list(enumerate(LINES)), "line_no long, value string")
    return parsed(text).where("ok").select("imsi", "ul_teid", "dl_teid", "rating_group", "apn")


@query("select user_id * 2 as teid, sum(28 + n)::bigint as bytes from base group by user_id having user_id >= 0 and sum(28 + n) > 0")
def dissector_totals(spark, sf_dir):
    """An external dissector's rows, made from the events, summed by tunnel."""
    from meterlake.sources import dissector

    n = F.least(F.lit(1400), F.round(F.col("value") * 4).cast("long"))
    six = F.col("event_id") % 2 == 1
    row = F.when(six, F.concat_ws("|", F.lit("eth:ip:udp:gtp:ipv6:udp"), F.concat(F.lit("0x"), F.hex(F.col("user_id") * 2)), F.lit("100"), (n - 12).cast("string")))
    row = row.otherwise(F.concat_ws("|", F.lit("eth:ethertype:ip:udp:gtp:ip:udp:data"), (F.col("user_id") * 2).cast("string"), F.concat(F.lit("900,"), (n + 28).cast("string")), F.lit("")))
    return dissector.teid_totals(contract.events(spark, sf_dir).select(row.alias("value")))


@query(record_sql(True) + "select * from cut_records")
def usage_records_stream(spark, sf_dir):
    """The record cutter as a stream over packets in files, ended by a mark for each subscriber."""
    import uuid

    from meterlake.streaming import meter_stream

    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    meter_stream.use_rocksdb(spark)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    p = plan(spark, sf_dir, CUTTING)
    p.packets.write.parquet(f"{root}/packets")
    bindings = sessions.bindings(p.sessions)
    zero = F.lit(0).cast("long")
    bindings.select("imsi").distinct().select("imsi", F.lit(-1).cast("long").alias("tick"), *(zero.alias(c) for c in records.SUMS)).write.parquet(f"{root}/marks")
    stream = spark.readStream.schema(p.packets.schema).parquet(f"{root}/packets")
    ticks = meter_stream.usage_ticks(stream, bindings, None, contract.START_NS, CUTTING)
    marks = spark.readStream.schema(ticks.schema).parquet(f"{root}/marks")
    out = meter_stream.records(ticks.unionByName(marks), CUTTING)
    try:
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.parquet(f"{root}/out").select("imsi", "seq", "reason", "start_tick", "end_tick", "ul_bytes", "dl_bytes")
