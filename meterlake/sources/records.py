"""Usage records that were written as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.report.documents import RECORD_SCHEMA


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """With imsi as a number and the packet columns under the names that operators use."""
    df = spark.read.schema(RECORD_SCHEMA).json(path)
    return df.withColumn("imsi", F.col("imsi").cast("long")).withColumnsRenamed({"ul_pkts": "ul_packets", "dl_pkts": "dl_packets"})
