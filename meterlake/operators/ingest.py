"""Packets to decoded frames, meter events and Gy events.

The cheapest tests come first and are native, so that only tunnel traffic is decoded further and only Diameter
segments reach Python. Frames keep pkt_no: it is the arrival order that later operators rely on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import ip
from meterlake.functions.bytes import fence, size
from meterlake.functions.diameter import diameter
from meterlake.functions.gtpu import GPDU, gtpu
from meterlake.plans.config import Config


def frames(packets: DataFrame, config: Config = Config()) -> DataFrame:
    """Of packets(pkt_no, ts_ns, orig_len, link_type, data): each frame's outer header and its route.

    route: gtpu, diameter, other (IP, but neither), non-ip. Packets of a link type that isn't read are left out.
    """
    df = ip.strip_link(packets).where("eth is not null or l3 is not null")
    df = ip.ethernet(df, "eth").withColumn("packet", F.coalesce("l3", "eth_payload"))
    df = ip.ip(df, "packet", "outer_")
    on = lambda port: F.coalesce((F.col("outer_src_port") == port) | (F.col("outer_dst_port") == port), F.lit(False))
    tunnel = (F.col("outer_proto") == ip.UDP) & on(config.gtpu_port)
    charging = F.col("outer_proto").isin(ip.TCP, ip.SCTP) & on(config.diameter_port) & F.lit(config.parse_diameter)
    route = F.when(~F.col("outer_valid"), "non-ip").when(tunnel, "gtpu").when(charging, "diameter").otherwise("other")
    wire = size(F.coalesce("eth", "l3"))
    return fence(df.select(
        "pkt_no", "ts_ns", "orig_len", wire.alias("wire_bytes"), F.coalesce("eth_vlan_tags", F.lit(0)).alias("vlan_tags"), "outer_version", "outer_proto", "outer_src", "outer_dst", "outer_src_port",
        "outer_dst_port", route.alias("route"), F.when(route == "gtpu", F.coalesce("outer_payload", F.lit(b""))).when(route == "diameter", F.col("outer_payload")).alias("payload"),
    ))


def tunnel_frames(routed: DataFrame) -> DataFrame:
    """The frames routed to GTP-U with their header's fields (gtpu_*)."""
    return fence(gtpu(routed.where("route = 'gtpu'"), "payload").drop("payload"))


def meter_events(tunnels: DataFrame, config: Config = Config()) -> DataFrame:
    """One row a GTP-U packet that could be read: what is charged, on which tunnel, for which inner flow."""
    df = tunnels.where("gtpu_status = 'ok'")
    user = F.col("gtpu_msg_type") == GPDU
    df = ip.ip(df.withColumn("inner", F.when(user, F.col("gtpu_payload"))), "inner", "inner_")
    valid = F.col("inner_valid")
    carried = size(F.col("gtpu_payload"))
    charged = F.when(~user, F.lit(0)).when(valid & F.lit(config.meter_inner_ip_length), F.col("inner_total_len")).otherwise(carried)
    direction = F.when(~F.col("gtpu_has_qfi"), "unknown").when(F.col("gtpu_pdu_type") == 1, "uplink").otherwise("downlink")
    return fence(df.select(
        "pkt_no", "ts_ns", F.col("gtpu_teid").alias("teid"), F.col("gtpu_msg_type").alias("msg_type"), (~user).alias("control"), charged.cast("long").alias("bytes"), "wire_bytes", direction.alias("dir"),
        F.col("gtpu_has_qfi").alias("has_qfi"), F.when(F.col("gtpu_has_qfi"), F.col("gtpu_qfi")).alias("qfi"), F.when(user, valid).alias("inner_parsed"), F.col("inner_version").cast("int").alias("ip_version"),
        F.col("inner_proto").alias("proto"), F.col("inner_src").alias("src_ip"), F.col("inner_dst").alias("dst_ip"), F.col("inner_src_port").alias("src_port"), F.col("inner_dst_port").alias("dst_port"),
        F.coalesce("inner_fragmented", F.lit(False)).alias("fragmented"),
    ))


def segments(routed: DataFrame) -> DataFrame:
    """The frames routed to Diameter that carry something: (pkt_no, ts_ns, status, messages)."""
    found = routed.where("route = 'diameter' and octet_length(payload) > 0").select("pkt_no", "ts_ns", diameter(F.col("payload")).alias("d"))
    return found.select("pkt_no", "ts_ns", "d.status", "d.messages")


def gy_events(read: DataFrame) -> DataFrame:
    """One row a service block of each credit-control message, one without usage where a message has none."""
    each = read.select("pkt_no", "ts_ns", F.posexplode("messages").alias("msg_no", "m")).where("m.command_code = 272")
    each = each.select("pkt_no", "ts_ns", "msg_no", "m.*").select("*", F.posexplode_outer("mscc").alias("block", "s"))
    octets = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0).cast("decimal(20,0)")).alias(c)
    return each.select(
        "pkt_no", "ts_ns", "msg_no", F.coalesce("block", F.lit(0)).alias("block"), F.col("imsi").try_cast("long").alias("imsi"), "has_imsi", "is_request", "cc_request_type", "cc_request_number", "result_code",
        F.coalesce("s.rating_group", F.lit(0).cast("long")).alias("rating_group"), octets("used_input_octets"), octets("used_output_octets"), octets("used_total_octets"), octets("granted_total_octets"),
        F.coalesce("s.has_used", F.lit(False)).alias("has_used"), F.coalesce("s.has_granted", F.lit(False)).alias("has_granted"),
    )


def outcomes(routed: DataFrame, tunnels: DataFrame, read: DataFrame) -> DataFrame:
    """Frames by what became of them: (outcome, frames); one aggregate over the narrow columns of each branch."""
    user = F.when(F.col("gtpu_status") != "ok", "parse-error").when(F.col("gtpu_msg_type") == GPDU, "metered").otherwise("gtpu-control")
    gy = F.exists("messages", lambda m: m["command_code"] == 272)
    charging = F.when(gy, "gy-control").when(F.col("status") != "ok", "parse-error").otherwise("not-our-traffic")
    empty = routed.where("route in ('other', 'non-ip') or (route = 'diameter' and coalesce(octet_length(payload), 0) = 0)").select(F.lit("not-our-traffic").alias("outcome"))
    return tunnels.select(user.alias("outcome")).unionByName(read.select(charging.alias("outcome"))).unionByName(empty).groupBy("outcome").agg(F.count("*").alias("frames"))


def totals(routed: DataFrame, read: DataFrame, config: Config = Config()) -> DataFrame:
    """The ingest counters, in one row: one pass over all frames, and one over the Diameter segments (segments())."""
    df = gtpu(routed.select("wire_bytes", "route", F.when(F.col("route") == "gtpu", F.col("payload")).alias("pdu")), "pdu").drop("pdu")
    ok, user = F.col("gtpu_status") == "ok", F.col("gtpu_msg_type") == GPDU
    df = fence(df.select("wire_bytes", "route", "gtpu_status", "gtpu_msg_type", F.when(ok & user, F.col("gtpu_payload")).alias("inner")))
    df = ip.ip(df, "inner", "inner_").select("wire_bytes", "route", "gtpu_status", "gtpu_msg_type", (F.col("inner").isNotNull() & ~F.col("inner_valid")).alias("odd"))
    a = df.agg(
        F.count("*").alias("frames"), F.coalesce(F.sum("wire_bytes"), F.lit(0)).alias("frames_bytes"), F.count_if(F.col("route") == "non-ip").alias("non_ip"),
        F.count_if(F.col("route") == "other").alias("not_gtpu_port"), F.count_if(~ok).alias("gtpu_parse_errors"),
        F.count_if(F.col("gtpu_status") == "truncated").alias("truncated_frames"), F.count_if(ok & user).alias("gtpu_gpdus"),
        F.count_if(ok & ~user).alias("gtpu_control"), F.count_if(ok).alias("events_pushed"), F.count_if("odd").alias("inner_parse_errors"),
    )
    blocks = F.aggregate(F.filter("messages", lambda m: m["command_code"] == 272), F.lit(0), lambda n, m: n + F.greatest(F.size(m["mscc"]), F.lit(1)))
    b = read.agg(
        F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("diameter_messages"), F.count_if(F.col("status") != "ok").alias("diameter_parse_errors"),
        F.coalesce(F.sum(blocks), F.lit(0)).alias("gy_events"),
    )
    zero = F.lit(0).cast("long")
    return a.crossJoin(b).withColumns({"events_dropped": zero, "gy_events_dropped": zero})  # one row each
