"""Rendering and parsing of scalar values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark of a QFI bucket, the unset bucket.
QFI_TAG, UNSET_BUCKET = 0x80000000, 0xFFFFFFFF
SUB_BUCKETS, MAX_SHIFT = 256, 39


def rfc3339(ts_ns: Column) -> Column:
    """UTC with milliseconds, truncated; the session's time zone has to be UTC."""
    return F.date_format(F.timestamp_millis(F.call_function("div", ts_ns, F.lit(1_000_000))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bucket_kind(bucket: Column) -> Column:
    return F.when(bucket.bitwiseAND(F.lit(QFI_TAG)) != 0, "qfi").otherwise("rating-group")


def bucket_number(bucket: Column) -> Column:
    return bucket.bitwiseAND(F.lit(QFI_TAG - 1))


def unsigned(text: Column) -> Column:
    """Decimal or 0x hexadecimal digits as a long; NULL for anything else, and beyond 63 bits."""
    digits = F.length(F.regexp_replace(F.substring(text, 3, 1 << 20), "^0+", ""))
    sixteen = F.when(text.rlike("^0[xX][0-9a-fA-F]+$") & (digits <= 15), F.conv(F.substring(text, 3, 1 << 20), 16, 10).cast("long"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(sixteen)


def histogram_index(value: Column) -> Column:
    """The log bucket of a value >= 0: exact below 256, then 256 steps to each power of two."""
    top = F.length(F.bin(value)) - 1
    shift = F.least(top - 7, F.lit(MAX_SHIFT))
    return F.when(value < SUB_BUCKETS, value).otherwise(shift * SUB_BUCKETS + F.call_function("shiftright", value, shift.cast("int")).bitwiseAND(F.lit(SUB_BUCKETS - 1))).cast("long")


def histogram_edge(index: Column) -> Column:
    """The largest value of a log bucket."""
    shift = F.call_function("div", index, F.lit(SUB_BUCKETS)).cast("int")
    inside = index.bitwiseAND(F.lit(SUB_BUCKETS - 1)) + 1
    return F.when(index < SUB_BUCKETS, index).otherwise(F.call_function("shiftleft", inside, shift) - 1)
