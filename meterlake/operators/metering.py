"""Attribution of meter events to subscribers, and what is counted.

Nearly everything is a sum over (TEID, direction hint, QFI), so events are combined to that before they meet the
bindings: one shuffle of combined rows, whatever the number of packets, and a busy tunnel is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.formats import QFI_TAG
from meterlake.functions.ip import flow_key


def direction(binding: Column, hint: Column) -> Column:
    """The binding's, else the packet's own, else uplink."""
    return F.when(binding.isin("uplink", "downlink"), binding).when(hint == "downlink", "downlink").otherwise("uplink")


SUMMED = ("teid", "dir", "has_qfi", "qfi")


def combined(events: DataFrame, tick: Column | None = None) -> DataFrame:
    """Events summed by (teid, dir, has_qfi, qfi, control) and, if given, by tick.

    Columns: bytes, packets, and the first and last packet's number and time. Only numbers are aggregated, so that it
    is done by hashing, without sorting the packets. Counters, buckets, records and totals all follow from it.
    """
    key = [*SUMMED, "control", *([tick.alias("tick")] if tick is not None else [])]
    return events.groupBy(*key).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("packets"), F.min("pkt_no").alias("first_pkt"),
        F.min_by("ts_ns", "pkt_no").alias("first_ns"), F.max("pkt_no").alias("last_pkt"), F.max_by("ts_ns", "pkt_no").alias("last_ns"),
    )


def usage(grid: DataFrame) -> DataFrame:
    """Of combined(): user packets by (teid, dir, has_qfi, qfi), whatever the ticks."""
    return grid.where("not control").groupBy(*SUMMED).agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.min("first_pkt").alias("first_pkt"),
        F.min_by("first_ns", "first_pkt").alias("first_ns"), F.max("last_pkt").alias("last_pkt"), F.max_by("last_ns", "last_pkt").alias("last_ns"),
    )


def bound(used: DataFrame, bindings: DataFrame) -> DataFrame:
    """usage() with its subscriber; imsi is NULL where the TEID is unknown."""
    return used.join(bindings, "teid", "left").withColumn("direction", F.when(F.col("imsi").isNotNull(), direction(F.col("binding_dir"), F.col("dir"))))


def learned(used: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bindings for unknown TEIDs: (teid, imsi, binding_dir of the first packet, rating_group 0, first_pkt, first_ns).

    Each is a subscriber of its own. It has no IMSI; the negative of its TEID stands in for one, so that no two of
    them share a key, and reports show 0 (see shown()).
    """
    unknown = used.join(bindings, "teid", "left_anti")
    first = unknown.groupBy("teid").agg(F.min_by(F.struct(F.col("dir").alias("binding_dir"), "first_pkt", "first_ns"), "first_pkt").alias("f"))
    return first.select("teid", (-F.col("teid")).alias("imsi"), "f.binding_dir", F.lit(0).cast("long").alias("rating_group"), "f.first_pkt", "f.first_ns")


def shown(imsi: Column) -> Column:
    """The IMSI as reports show it: 0 for a learned subscriber."""
    return F.greatest(imsi, F.lit(0).cast("long"))


def counters(attributed: DataFrame, *key: str) -> DataFrame:
    """Per subscriber: ul_bytes, dl_bytes, ul_packets, dl_packets, last_seen_ns (of the last packet, not the largest)."""
    key = key or ("imsi",)
    up, down = F.col("direction") == "uplink", F.col("direction") == "downlink"
    total = lambda what, side: F.coalesce(F.sum(F.when(side, F.col(what))), F.lit(0)).alias
    return attributed.where("imsi is not null").groupBy(*key).agg(
        total("bytes", up)("ul_bytes"), total("bytes", down)("dl_bytes"), total("packets", up)("ul_packets"), total("packets", down)("dl_packets"), F.max_by("last_ns", "last_pkt").alias("last_seen_ns")
    )


def unknown_by_teid(attributed: DataFrame) -> DataFrame:
    return attributed.where("imsi is null").groupBy("teid").agg(F.sum("packets").alias("events"), F.sum("bytes").alias("bytes"))


def totals(grid: DataFrame, attributed: DataFrame) -> DataFrame:
    """One row: events, bytes (unknown ones included), control_pdus, and by direction, unknown, last_event_ns. grid: combined()."""
    zero = F.lit(0).cast("long")
    a = grid.agg(
        F.coalesce(F.sum("packets"), zero).alias("events"), F.coalesce(F.sum("bytes"), zero).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("control"), F.col("packets"))), zero).alias("control_pdus"), F.max_by("last_ns", "last_pkt").alias("last_event_ns"),
    )
    s = lambda what, cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col(what))), F.lit(0)).alias
    b = attributed.agg(
        s("bytes", "direction = 'uplink'")("ul_bytes"), s("bytes", "direction = 'downlink'")("dl_bytes"), s("packets", "direction = 'uplink'")("ul_packets"), s("packets", "direction = 'downlink'")("dl_packets"),
        s("packets", "imsi is null")("unknown_teid_events"), s("bytes", "imsi is null")("unknown_teid_bytes"),
    )
    return a.crossJoin(b)  # one row each


def bucket() -> Column:
    """The accounting bucket of a row with has_qfi, qfi and rating_group."""
    return F.when(F.col("has_qfi"), F.lit(QFI_TAG).bitwiseOR(F.col("qfi").cast("long"))).otherwise(F.col("rating_group"))


def buckets(attributed: DataFrame, groups: DataFrame, *key: str) -> DataFrame:
    """Per subscriber the accounting buckets in first-come order: (key, bucket, slot, bytes, packets, first_pkt, ids).

    groups: (key, bucket, first_line), the rating groups a session has had; they rank before any QFI, with 0 bytes
    where nothing was charged to them. The third and later share slot 2; ids counts the subscriber's buckets.
    """
    key = key or ("imsi",)
    charged = attributed.where("imsi is not null").select(*key, bucket().alias("bucket"), "bytes", "packets", "first_pkt", F.lit(None).cast("long").alias("first_line"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    installed = groups.select(*key, "bucket", zero.alias("bytes"), zero.alias("packets"), none.alias("first_pkt"), "first_line")
    each = charged.unionByName(installed).groupBy(*key, "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.min("first_pkt").alias("first_pkt"), F.min("first_line").alias("first_line"))
    order = Window.partitionBy(*key).orderBy(F.col("first_line").asc_nulls_last(), "first_pkt", "bucket")
    return each.withColumns({"slot": F.least(F.row_number().over(order), F.lit(3)) - 1, "ids": F.count("*").over(Window.partitionBy(*key))})


def slots(ranked: DataFrame, *key: str) -> DataFrame:
    """buckets() by slot: (key, slot, bucket (the first to take the slot), bytes, aggregated)."""
    key = key or ("imsi",)
    order = F.struct(F.coalesce("first_line", F.lit(2**63 - 1)), F.coalesce("first_pkt", F.lit(-1)), "bucket")
    return ranked.groupBy(*key, "slot").agg(F.min_by("bucket", order).alias("bucket"), F.sum("bytes").alias("bytes"), ((F.col("slot") == 2) & (F.max("ids") > 3)).alias("aggregated"))


TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "proto", "ip_version")


def flows(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """User packets of bound tunnels by inner 5-tuple: bytes, packets, last ts, and the first packet's attributes.

    Packets without an inner IP header share the flow with key 1. Nothing is evicted. Packets are summed by tuple and
    tunnel before they meet the bindings; the key is computed once a flow.
    """
    user = events.where("not control").groupBy(*TUPLE, "teid", "dir").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("packets"), F.max("pkt_no").alias("last_pkt"), F.max_by("ts_ns", "pkt_no").alias("last_ns"),
        F.min("pkt_no").alias("first_pkt"), F.min_by("qfi", "pkt_no").alias("qfi"),
    )
    known = user.join(bindings.select("teid", "imsi", "binding_dir"), "teid")
    known = known.withColumn("down", (direction(F.col("binding_dir"), F.col("dir")) == "downlink").cast("int"))
    first = lambda c: F.min_by(c, "first_pkt").alias(c)
    grouped = known.groupBy(*TUPLE).agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.max_by("last_ns", "last_pkt").alias("last_seen_ns"),
        *map(first, ("teid", "imsi", "down", "qfi")), F.min("first_pkt").alias("first_pkt"),
    )
    key = F.when(F.col("ip_version").isNull(), F.lit(1).cast("long")).otherwise(flow_key(*(F.col(c) for c in TUPLE)))
    return grouped.select(F.when(key == 0, 1).otherwise(key).alias("flow_key"), *TUPLE, "teid", "imsi", F.when(F.col("down") == 1, "downlink").otherwise("uplink").alias("direction"), "qfi", "bytes", "packets", "last_seen_ns", "first_pkt")


def top(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` rows with the largest first column of ``by``; the others break ties, ascending."""
    return df.orderBy(F.desc(by[0]), *by[1:]).limit(n)
