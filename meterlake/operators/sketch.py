"""A log-bucket quantile sketch: counts by bucket add up, so it combines before the shuffle and merges by union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.formats import histogram_edge, histogram_index

QUANTILES = (0.5, 0.9, 0.99, 0.999, 0.9999)


def histogram(df: DataFrame, value: str, *key: str) -> DataFrame:
    """(key, idx, edge, n): the count of each bucket that isn't empty and its largest value. At most 10,240 a key."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, histogram_index(F.col(value)).alias("idx")).agg(F.count("*").alias("n"))
    return counted.select(*key, "idx", histogram_edge(F.col("idx")).alias("edge"), "n")


def merge(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    return a.unionByName(b).groupBy(*key, "idx", "edge").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, which: tuple = QUANTILES, *key: str) -> DataFrame:
    """(key, quantile, value): the edge of the first bucket at which floor(q n + 0.5) values are reached."""
    part = Window.partitionBy(*(key or [F.lit(0)]))
    seen = sketch.withColumns({"seen": F.sum("n").over(part.orderBy("idx")), "total": F.sum("n").over(part)})
    each = seen.select("*", F.explode(F.array(*map(F.lit, which))).alias("quantile")).where(F.col("seen") >= F.floor(F.col("quantile") * F.col("total") + 0.5))
    return each.groupBy(*key, "quantile").agg(F.min("edge").alias("value"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: count, min, max, mean, and p50 to p9999 from the sketch."""
    exact = df.agg(F.count(value).alias("count"), F.min(value).alias("min_ns"), F.max(value).alias("max_ns"), F.round(F.avg(value), 1).alias("mean_ns"))
    named = dict(zip(QUANTILES, ("p50_ns", "p90_ns", "p99_ns", "p999_ns", "p9999_ns"), strict=True))
    got = quantiles(histogram(df, value)).agg(*(F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n) for q, n in named.items()))
    return exact.crossJoin(got)  # one row each


def sampled(df: DataFrame, every: int, number: str = "pkt_no") -> DataFrame:
    """Each ``every``-th packet in order of arrival, from the ``every``-th on."""
    return df.where(F.pmod(F.col(number), F.lit(every)) == every - 1) if every > 1 else df
