"""Verification of outputs against inputs and against one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def teid_totals(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """Records summed back to tunnels: (teid, bytes); tunnels without any are left out."""
    used = records.groupBy("imsi").agg(F.sum("ul_bytes").alias("ul"), F.sum("dl_bytes").alias("dl"))
    each = used.join(sessions, "imsi").select(F.explode(F.array(F.struct(F.col("ul_teid").alias("teid"), F.col("ul").alias("bytes")), F.struct(F.col("dl_teid").alias("teid"), F.col("dl").alias("bytes")))).alias("t")).select("t.*")
    return each.groupBy("teid").agg(F.sum("bytes").alias("bytes")).where("bytes > 0")


def rollup(records: DataFrame) -> DataFrame:
    """Per IMSI: the four sums and whether the sequence numbers are 0, 1, ... without a gap."""
    gapless = (F.min("seq") == 0) & (F.max("seq") == F.count("*") - 1) & (F.count_distinct("seq") == F.count("*"))
    return records.groupBy("imsi").agg(*(F.sum(c).alias(c) for c in ("ul_bytes", "dl_bytes", "ul_packets", "dl_packets")), F.count("*").alias("records"), gapless.alias("gapless"))


def mismatches(expected: DataFrame, actual: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of either side that the other doesn't have alike."""
    e, a = expected.select(key, *(F.col(c).alias(f"expected_{c}") for c in columns)), actual.select(key, *(F.col(c).alias(f"actual_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"expected_{c}").eqNullSafe(F.col(f"actual_{c}"))
    return e.join(a, key, "full_outer").where(~same)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The symmetric difference: rows with ``side`` left or right."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
