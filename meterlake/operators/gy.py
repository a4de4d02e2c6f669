"""What the charging plane reported, and how it compares with what was metered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reported(gy_events: DataFrame, distinct: bool = False) -> DataFrame:
    """Per IMSI the octets used: (imsi, gy_reported_octets, gy_reports, gy_last_ns).

    Every block with an IMSI and a used amount counts, repeated messages too. With ``distinct``, messages that say
    the same for the same request number count once.
    """
    rows = gy_events.where("has_imsi and has_used")
    if distinct:
        rows = rows.groupBy("imsi", "cc_request_type", "cc_request_number", "rating_group", "used_total_octets", "is_request").agg(F.min("pkt_no").alias("pkt_no"), F.min("ts_ns").alias("ts_ns"))
    return rows.groupBy("imsi").agg(F.sum("used_total_octets").alias("gy_reported_octets"), F.count("*").alias("gy_reports"), F.max_by("ts_ns", "pkt_no").alias("gy_last_ns"))


def crosscheck(counters: DataFrame, found: DataFrame) -> DataFrame:
    """Subscribers with reports: (imsi, metered_octets, reported_octets, difference, reports)."""
    metered = F.col("ul_bytes") + F.col("dl_bytes")
    octets = F.col("gy_reported_octets").cast("long")
    return counters.join(found, "imsi").select("imsi", metered.alias("metered_octets"), octets.alias("reported_octets"), (metered - octets).alias("difference"), F.col("gy_reports").alias("reports"))
