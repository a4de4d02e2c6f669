"""Session tables as text: imsi,ul_teid,dl_teid,rating_group,msisdn,apn.

Comments, headers and blank lines are passed over; lines that can't be a session are left out and counted. Numbers are
decimal or 0x hexadecimal; a rating group that can't be read is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.formats import unsigned
from meterlake.operators.sessions import MAX_TEID

#: No block of a file has so many lines.
BLOCK_LINES = 1 << 33
HEADER = "imsi,ul_teid,dl_teid,rating_group,msisdn,apn"


def parsed(lines: DataFrame) -> DataFrame:
    """Of lines (line_no, value): the six columns, and ``ok``; comments, headers and blank lines are gone."""
    df = lines.withColumn("value", F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "")).where("value <> '' and not startswith(value, '#') and not startswith(value, 'imsi')")
    df = df.withColumn("c", F.transform(F.split("value", ","), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")))
    # a trailing comma opens no column
    df = df.withColumn("n", F.size("c") - F.when(F.element_at("c", -1) == "", 1).otherwise(0))
    number = lambda i: unsigned(F.get("c", F.lit(i)))
    rating = F.when(number(3) <= MAX_TEID, number(3))
    df = df.select("line_no", number(0).alias("imsi"), number(1).alias("ul_teid"), number(2).alias("dl_teid"), F.coalesce(rating, F.lit(0)).cast("long").alias("rating_group"), F.coalesce(F.get("c", F.lit(4)), F.lit("")).alias("msisdn"), F.coalesce(F.get("c", F.lit(5)), F.lit("")).alias("apn"), "n")
    ok = (F.col("n") >= 3) & (F.col("imsi") != 0) & (F.col("ul_teid") <= MAX_TEID) & (F.col("dl_teid") <= MAX_TEID) & ((F.col("ul_teid") != 0) | (F.col("dl_teid") != 0))
    return df.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("n")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value); numbers rise within a file, and files follow one another by name, however Spark packs its tasks.

    A block of a file is read from its start by one task, so its rows' ids rise; blocks are ranked by file and place.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    block = ["_path", "_start"]
    ranked = rows.groupBy(*block).agg(F.min("_id").alias("_least")).withColumn("_block", F.row_number().over(Window.orderBy(*block)) - 1)  # a row a block
    return rows.join(ranked, block).select((F.col("_block").cast("long") * BLOCK_LINES + F.col("_id") - F.col("_least")).alias("line_no"), "value")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return parsed(lines(spark, path)).where("ok").drop("ok")


def skipped(spark: SparkSession, path: str) -> int:
    return parsed(lines(spark, path)).where("not ok").count()
