"""Counters and gauges as rows, and their text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "meterlake_"
# Fixed values: (name, what it counts, table, column); {direction} names a label's value.
COUNTERS = (
    ("ingest_frames_total", "Frames read", "ingest", "frames"),
    ("ingest_frame_bytes_total", "Bytes of the frames read", "ingest", "frames_bytes"),
    ("ingest_gpdus_total", "GTP-U user packets", "ingest", "gtpu_gpdus"),
    ("ingest_gtpu_control_total", "GTP-U control messages", "ingest", "gtpu_control"),
    ("ingest_parse_errors_total", "GTP-U packets that could not be read", "ingest", "gtpu_parse_errors"),
    ("ingest_inner_parse_errors_total", "Tunnelled payloads that are not IP", "ingest", "inner_parse_errors"),
    ("ingest_not_our_traffic_total", "Frames that are neither GTP-U nor Diameter", "ingest", "not_our_traffic"),
    ("ingest_events_pushed_total", "Meter events made", "ingest", "events_pushed"),
    ("ingest_events_dropped_total", "Meter events lost", "ingest", "events_dropped"),
    ("diameter_messages_total", "Diameter messages read", "ingest", "diameter_messages"),
    ("diameter_parse_errors_total", "Diameter messages that could not be read", "ingest", "diameter_parse_errors"),
    ("meter_events_total", "Events metered", "meter", "events"),
    ("meter_bytes_total", "Bytes metered", "meter", "bytes"),
    ('meter_direction_bytes_total{direction="uplink"}', "Bytes metered by direction", "meter", "ul_bytes"),
    ('meter_direction_bytes_total{direction="downlink"}', "Bytes metered by direction", "meter", "dl_bytes"),
    ('meter_direction_packets_total{direction="uplink"}', "Packets metered by direction", "meter", "ul_packets"),
    ('meter_direction_packets_total{direction="downlink"}', "Packets metered by direction", "meter", "dl_packets"),
    ("teid_bind_failures_total", "Sessions that could not be bound", "meter", "teid_bind_failures"),
    ("meter_unknown_teid_events_total", "Packets on an unknown tunnel", "meter", "unknown_teid_events"),
    ("meter_unknown_teid_bytes_total", "Bytes on an unknown tunnel", "meter", "unknown_teid_bytes"),
    ("meter_flow_inserts_total", "Flows seen", "meter", "flows_active"),
    ("meter_flow_evictions_total", "Flows evicted", "meter", "flow_evictions"),
    ("usage_records_emitted_total", "Usage records cut", "meter", "records_emitted"),
    ("usage_records_dropped_total", "Usage records lost", "meter", "records_dropped"),
    ("usage_records_written_total", "Usage records written", "meter", "records_written"),
    ("gy_events_total", "Charging events", "ingest", "gy_events"),
    ("gy_reported_octets_total", "Octets that the charging plane reported", "meter", "gy_reported_octets"),
)
GAUGES = (
    ("subscribers_active", "Subscribers that are active", "subscribers_active"),
    ("flows_active", "Flows in the table", "flows_active"),
    ("uptime_seconds", "Seconds since the start", "uptime_s"),
)
QUANTILES = (("0.5", "p50_ns"), ("0.9", "p90_ns"), ("0.99", "p99_ns"), ("0.999", "p999_ns"), ("0.9999", "p9999_ns"))


def series(one_row: DataFrame) -> DataFrame:
    """Of Metering.state(): rows (name, value), all counters and the gauges but the time since the start."""
    named = [(PREFIX + name, column) for name, _, _, column in COUNTERS] + [(PREFIX + name, column) for name, _, column in GAUGES if column != "uptime_s"]
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("value")) for n, c in named))
    return one_row.select(F.explode(rows).alias("s")).select("s.*")


def gauge_text(x: float) -> str:
    return f"{x:.6g}"


def render(state: dict, latency: dict | None = None, talkers: list[dict] | None = None) -> str:
    """The exposition text. state: the counters' columns and gauges; talkers: rows of subscribers, largest first."""
    out, said = [], set()
    for name, help_, _, column in COUNTERS:
        base = name.partition("{")[0]
        if base not in said:
            out += [f"# HELP {PREFIX}{base} {help_}", f"# TYPE {PREFIX}{base} counter"]
            said.add(base)
        out.append(f"{PREFIX}{name} {int(state.get(column) or 0)}")
    for name, help_, column in GAUGES:
        out += [f"# HELP {PREFIX}{name} {help_}", f"# TYPE {PREFIX}{name} gauge", f"{PREFIX}{name} {gauge_text(float(state.get(column) or 0))}"]
    latency = latency or {}
    base = f"{PREFIX}e2e_latency_ns"
    out += [f"# HELP {base} Latency from capture to counter, sampled", f"# TYPE {base} summary"]
    out += [f'{base}{{quantile="{q}"}} {int(latency.get(c) or 0)}' for q, c in QUANTILES]
    out += [f"{base}_max {int(latency.get('max_ns') or 0)}", f"{base}_count {int(latency.get('count') or 0)}"]
    if talkers:
        base = f"{PREFIX}subscriber_bytes_total"
        out += [f"# HELP {base} Bytes of the busiest subscribers", f"# TYPE {base} counter"]
        for row in talkers:
            out += [f'{base}{{imsi="{row["imsi"]}",direction="{d}"}} {int(row[c])}' for d, c in (("uplink", "ul_bytes"), ("downlink", "dl_bytes"))]
    return "\n".join(out) + "\n"
