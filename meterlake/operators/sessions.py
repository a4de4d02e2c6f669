"""The session dimension: installs, modifications and releases as tables.

sessions: (line_no, imsi, ul_teid, dl_teid, rating_group, msisdn, apn), line_no the order of installation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TEID = 0xFFFFFFFF
#: Learned subscribers follow all lines of session tables.
LEARNED_LINE = 1 << 62


def valid(sessions: DataFrame) -> DataFrame:
    """Sessions that can be installed: an IMSI, and at least one tunnel."""
    return sessions.where("imsi is not null and imsi <> 0 and (coalesce(ul_teid, 0) <> 0 or coalesce(dl_teid, 0) <> 0)").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ul_teid", "dl_teid", "rating_group")})


def subscribers(sessions: DataFrame) -> DataFrame:
    """One row an IMSI: (imsi, first_line, ul_teid, dl_teid, rating_group, msisdn, apn, installs); the last install holds."""
    last = lambda c: F.max_by(c, "line_no").alias(c)
    return valid(sessions).groupBy("imsi").agg(F.min("line_no").alias("first_line"), *(last(c) for c in ("ul_teid", "dl_teid", "rating_group", "msisdn", "apn")), F.count("*").alias("installs"))


#: Subscribers are numbered within blocks of so many places of their first install.
PLACES = 1 << 16


def numbered(installed: DataFrame) -> DataFrame:
    """Adds ``sub``: 0, 1, ... in the order of first installs.

    Places are whole numbers, so a block of PLACES neighbouring ones has no more subscribers than places (unless
    several share one) and is ranked by itself; the blocks' counts, a 65,536th of the rows, are summed in order. Blocks
    follow from the data alone, so that it doesn't matter how often or where the plan runs.
    """
    block = F.shiftright("first_line", PLACES.bit_length() - 1)
    rows = installed.withColumn("_block", block)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    base = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("first_line", "imsi")) - 1
    return rows.join(base, "_block").withColumn("sub", F.col("_base") + rank).drop("_block", "_base")


def bindings(sessions: DataFrame) -> DataFrame:
    """One row a TEID: (teid, imsi, binding_dir, rating_group); the last session to claim a TEID owns it.

    A TEID that its own session has since given up is bound no more.
    """
    rows = valid(sessions)
    now = subscribers(sessions).select("imsi", F.col("ul_teid").alias("now_ul"), F.col("dl_teid").alias("now_dl"), F.col("rating_group").alias("now_rg"))
    each = rows.select("imsi", "line_no", F.explode(F.array(F.struct(F.col("ul_teid").alias("teid"), F.lit("uplink").alias("binding_dir")), F.struct(F.col("dl_teid").alias("teid"), F.lit("downlink").alias("binding_dir")))).alias("t")).select("imsi", "line_no", "t.*").where("teid <> 0")
    owner = each.groupBy("teid").agg(F.max_by(F.struct("imsi", "binding_dir"), F.struct("line_no", F.col("binding_dir") == "downlink")).alias("o")).select("teid", "o.*")
    held = owner.join(now, "imsi").where("teid = case when binding_dir = 'uplink' then now_ul else now_dl end")
    return held.select("teid", "imsi", "binding_dir", F.col("now_rg").alias("rating_group"))


def rating_groups(sessions: DataFrame) -> DataFrame:
    """The rating groups each IMSI has had: (imsi, bucket, first_line)."""
    return valid(sessions).groupBy("imsi", F.col("rating_group").alias("bucket")).agg(F.min("line_no").alias("first_line"))


def timeline(control: DataFrame) -> DataFrame:
    """Installs and releases over time as validity intervals of bindings.

    control: (ctl_no, pkt_no, op install|release, imsi, ul_teid, dl_teid, rating_group); an operation takes effect
    before the packet of its pkt_no. Returns (teid, imsi, incarnation, binding_dir, rating_group, from_pkt, to_pkt): a
    packet is bound by from_pkt <= pkt_no < to_pkt. A re-install while active keeps the incarnation (counters go on);
    one after a release opens the next (counters start anew). Control rows are few beside packets.
    """
    by = Window.partitionBy("imsi").orderBy("ctl_no")
    steps = control.withColumns({"was": F.lag("op").over(by), "next_pkt": F.lead("pkt_no").over(by)}).where("op = 'install' or was = 'install'")
    steps = steps.withColumn("incarnation", F.count_if((F.col("op") == "install") & (F.coalesce("was", F.lit("release")) == "release")).over(by) - 1)
    open_ = steps.where("op = 'install'").select("imsi", "incarnation", "ctl_no", "rating_group", F.col("pkt_no").alias("from_pkt"), F.coalesce("next_pkt", F.lit(2**63 - 1)).alias("until"), F.explode(F.array(F.struct(F.col("ul_teid").alias("teid"), F.lit("uplink").alias("binding_dir")), F.struct(F.col("dl_teid").alias("teid"), F.lit("downlink").alias("binding_dir")))).alias("t")).select("*", "t.*").drop("t").where("teid <> 0")
    claim = Window.partitionBy("teid").orderBy("ctl_no", F.col("binding_dir") == "downlink")
    return open_.withColumn("claimed", F.lead("from_pkt").over(claim)).select("teid", "imsi", "incarnation", "binding_dir", "rating_group", "from_pkt", F.least("until", F.coalesce("claimed", F.lit(2**63 - 1))).alias("to_pkt")).where("from_pkt < to_pkt")


def releases(control: DataFrame) -> DataFrame:
    """The releases that end an active session: (imsi, pkt_no); a second one in a row does nothing."""
    by = Window.partitionBy("imsi").orderBy("ctl_no")
    return control.withColumn("was", F.lag("op").over(by)).where("op = 'release' and was = 'install'").select("imsi", "pkt_no")


def bind_at(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Meter events with the binding that held at their packet; NULL where none did."""
    e, b = events.alias("e"), intervals.withColumnRenamed("teid", "b_teid").alias("b")
    return e.join(b, (F.col("teid") == F.col("b_teid")) & (F.col("pkt_no") >= F.col("from_pkt")) & (F.col("pkt_no") < F.col("to_pkt")), "left").drop("b_teid", "from_pkt", "to_pkt")
