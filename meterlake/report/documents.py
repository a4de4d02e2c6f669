"""JSON documents, usage records as lines, and the summary text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.formats import bucket_kind, bucket_number, rfc3339
from meterlake.functions.ip import format_ip
from meterlake.operators.metering import shown

RECORD_SCHEMA = "ts string, imsi string, sub long, seq long, reason string, ul_bytes long, dl_bytes long, ul_pkts long, dl_pkts long, interval_ns long, buckets array<struct<kind: string, id: long, bytes: long, aggregate: boolean>>"


def record_lines(records: DataFrame, numbered: DataFrame, start_ns: int, tick_ns: int) -> DataFrame:
    """records_with_buckets() as one JSON object a line (column value); numbered: (imsi, sub)."""
    named = records.join(numbered.select("imsi", "sub"), "imsi")
    at = F.lit(start_ns) + F.col("end_tick") * tick_ns
    return named.select(F.to_json(F.struct(
        rfc3339(at).alias("ts"), shown(F.col("imsi")).cast("string").alias("imsi"), "sub", "seq", "reason", "ul_bytes", "dl_bytes", F.col("ul_packets").alias("ul_pkts"), F.col("dl_packets").alias("dl_pkts"),
        ((F.col("end_tick") - F.col("start_tick")) * tick_ns).alias("interval_ns"), "buckets",
    )).alias("value"))


def write_records(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def bucket_array(slotted: DataFrame) -> DataFrame:
    """metering.slots() as one array a subscriber: (imsi, buckets, bucket_aggregated)."""
    one = F.struct("slot", bucket_kind(F.col("bucket")).alias("kind"), bucket_number(F.col("bucket")).alias("id"), "bytes")
    each = slotted.groupBy("imsi").agg(F.array_sort(F.collect_list(one)).alias("b"), F.max("aggregated").alias("bucket_aggregated"))  # three at most
    return each.select("imsi", F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"), x["bytes"].alias("bytes"))).alias("buckets"), "bucket_aggregated")


def subscriber_rows(counters: DataFrame, installed: DataFrame, slotted: DataFrame, gy_totals: DataFrame) -> DataFrame:
    """One JSON object a subscriber (columns imsi, total, value). installed: sessions.numbered()."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    df = installed.select("imsi", "sub", "ul_teid", "dl_teid").join(counters, "imsi", "left").join(gy_totals, "imsi", "left").join(bucket_array(slotted), "imsi", "left")
    doc = F.struct(shown(F.col("imsi")).cast("string").alias("imsi"), "sub", "ul_teid", "dl_teid", *map(zero, ("ul_bytes", "dl_bytes", "ul_packets", "dl_packets", "gy_reported_octets", "gy_reports")), "buckets", "bucket_aggregated")
    return df.select("imsi", "sub", (F.coalesce("ul_bytes", F.lit(0)) + F.coalesce("dl_bytes", F.lit(0))).alias("total"), F.to_json(doc).alias("value"))


def flow_rows(flows: DataFrame, installed: DataFrame, source: Callable[[Column], Column] = format_ip) -> DataFrame:
    """One JSON object a flow (columns bytes, flow_key, value). source: how the inner source address is written."""
    doc = F.struct(
        "teid", "sub", source(F.col("src_ip")).alias("src"), format_ip(F.col("dst_ip")).alias("dst"), F.coalesce("src_port", F.lit(0)).alias("src_port"), F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
        F.coalesce("proto", F.lit(0)).alias("proto"), F.coalesce("qfi", F.lit(0)).alias("qfi"), "direction", "bytes", "packets",
    )
    return flows.join(installed.select("imsi", "sub"), "imsi").select("bytes", "flow_key", F.to_json(doc).alias("value"))


# The sections of the counters' document and their fields.
SECTIONS = {
    "ingest": {"frames": "frames", "bytes": "frames_bytes", "gpdus": "gtpu_gpdus", "control": "gtpu_control", "parse_errors": "gtpu_parse_errors", "events_pushed": "events_pushed", "events_dropped": "events_dropped", "diameter_messages": "diameter_messages"},
    "meter": {
        "events": "events", "bytes": "bytes", "ul_bytes": "ul_bytes", "dl_bytes": "dl_bytes", "ul_packets": "ul_packets", "dl_packets": "dl_packets", "unknown_teid_events": "unknown_teid_events", "unknown_teid_bytes": "unknown_teid_bytes",
        "teid_bind_failures": "teid_bind_failures", "flows_active": "flows_active", "flow_evictions": "flow_evictions", "records_emitted": "records_emitted", "records_dropped": "records_dropped", "records_written": "records_written", "gy_events": "gy_events",
    },
    "teid_table": {"size": "teids_bound"},
    "latency_ns": {"count": "count", "min": "min_ns", "p50": "p50_ns", "p90": "p90_ns", "p99": "p99_ns", "p999": "p999_ns", "p9999": "p9999_ns", "max": "max_ns", "mean": "mean_ns"},
}


def stats_document(one_row: DataFrame) -> DataFrame:
    """The counters of Metering.state() as a nested JSON document (column value)."""
    sections = [F.struct(*(F.coalesce(F.col(column), F.lit(0)).alias(name) for name, column in fields.items())).alias(section) for section, fields in SECTIONS.items()]
    return one_row.select(F.to_json(F.struct(*sections)).alias("value"))


def csv_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions as the lines that sources.sessions reads (column value), for one file under a header."""
    return sessions.orderBy("line_no").select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("imsi", "ul_teid", "dl_teid", "rating_group", "msisdn", "apn"))).alias("value"))


def summary(state: dict, elapsed_s: float = 0.0, latency: dict | None = None) -> str:
    """The end-of-run text: a label and its numbers a line."""
    s = lambda k: int(state.get(k) or 0)
    rate = lambda x: x / elapsed_s / 1e6 if elapsed_s > 0 else 0.0
    lines = [
        ("elapsed", f"{elapsed_s:.3f} s"),
        ("frames ingested", f"{s('frames')} ({rate(s('frames')):.3f} Mpps)"),
        ("bytes ingested", f"{s('frames_bytes')} ({rate(s('frames_bytes')) * 8 / 1e3:.3f} Gbps)"),
        ("GTP-U G-PDUs", s("gtpu_gpdus")),
        ("GTP-U control", s("gtpu_control")),
        ("GTP-U parse errors", s("gtpu_parse_errors")),
        ("Diameter messages", f"{s('diameter_messages')} (errors {s('diameter_parse_errors')})"),
        ("not our traffic", s("not_gtpu_port") + s("non_ip")),
        ("events dropped", s("events_dropped")),
        ("metered events", s("events")),
        ("metered bytes", f"{s('bytes')} (ul {s('ul_bytes')} / dl {s('dl_bytes')})"),
        ("unknown TEID", f"{s('unknown_teid_events')} events, {s('unknown_teid_bytes')} bytes"),
        ("flows", f"{s('flows_active')} active, {s('flow_evictions')} evictions"),
        ("usage records", f"{s('records_emitted')} emitted, {s('records_written')} written, {s('records_dropped')} dropped"),
        ("Gy events", f"{s('gy_events')} ({s('gy_reported_octets')} octets reported)"),
    ]
    if latency and latency.get("count"):
        lines.append(("e2e latency (ns)", f"n={latency['count']} p50={latency['p50_ns']} p99={latency['p99_ns']} p99.9={latency['p999_ns']} p99.99={latency['p9999_ns']} max={latency['max_ns']}"))
    return "=== usage metering summary ===\n" + "".join(f"  {k:<20} {v}\n" for k, v in lines)
