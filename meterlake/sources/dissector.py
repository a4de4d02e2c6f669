"""Rows of an external dissector: protocols|teid|ip.len|ipv6.plen, lists separated by commas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.formats import unsigned


def teid_totals(lines: DataFrame) -> DataFrame:
    """Of lines (value): (teid, bytes), by the layer directly inside the last tunnel; totals of 0 are left out."""
    df = lines.select(F.split("value", r"\|").alias("c")).select(*(F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("protocols", "teid", "ip", "ip6"))))
    layers = F.filter(F.split("protocols", ":"), lambda x: x != "")
    df = df.withColumns({"layers": layers, "teid": unsigned(F.lower(F.trim("teid")))})
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("layers"), F.lit(1))), lambda i: F.when(F.get("layers", i - 1).startswith("gtp"), i)))
    df = df.withColumn("inner", F.get("layers", last))
    final = lambda c: F.try_element_at(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), F.lit(-1))
    length = F.when(F.col("inner") == "ip", F.trim(final("ip")).cast("long")).when(F.col("inner") == "ipv6", F.trim(final("ip6")).cast("long") + 40)
    return df.withColumn("bytes", length).where("teid is not null and bytes is not null").groupBy("teid").agg(F.sum("bytes").alias("bytes")).where("bytes > 0")
