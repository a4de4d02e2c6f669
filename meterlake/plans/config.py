"""Settings with the meaning they have in batch and streaming; all are keyword arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    gtpu_port: int = 2152
    diameter_port: int = 3868
    parse_diameter: bool = True
    meter_inner_ip_length: bool = True  # charge the inner header's length, else the captured bytes
    learn_unknown_teids: bool = False
    track_flows: bool = True
    report_interval_ns: int = 10_000_000_000  # 0: no record by time
    volume_threshold_bytes: int = 100 << 20  # 0: no record by volume
    start_ns: int = 0  # where the ticks are counted from
    tick_ns: int = 100_000_000  # how often open records are looked at
    latency_sample_every: int = 8
    top_flows: int = 64
    top_subscribers: int = 4096
