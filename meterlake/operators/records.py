"""Usage records: per subscriber, what was used since the last record.

Records are cut on a grid of ticks: an event is seen at the first tick at or after it, all subscribers are looked at
at every tick, volume wins over time, and nothing is cut for time while nothing is pending. Usage is summed by
(subscriber, tick) first, so a subscriber is at most a row a tick; sorted by tick within its partition, the fold is
one pass with a few numbers of state, whatever the subscriber's size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ("ul_bytes", "dl_bytes", "ul_packets", "dl_packets", "slot0", "slot1", "slot2")


def tick_of(start_ns: int, tick_ns: int) -> Column:
    """The first tick at or after ts_ns."""
    return F.call_function("div", F.col("ts_ns") - F.lit(start_ns) + F.lit(tick_ns - 1), F.lit(tick_ns))


def ticks(attributed: DataFrame) -> DataFrame:
    """Of usage with (imsi, tick, direction, slot, bytes, packets): SUMS by (imsi, tick)."""
    side = lambda d, what: F.sum(F.when(F.col("direction") == d, F.col(what)).otherwise(F.lit(0))).cast("long")
    slot = lambda k: F.sum(F.when(F.col("slot") == k, F.col("bytes")).otherwise(F.lit(0))).cast("long").alias(f"slot{k}")
    return attributed.groupBy("imsi", "tick").agg(
        side("uplink", "bytes").alias("ul_bytes"), side("downlink", "bytes").alias("dl_bytes"),
        side("uplink", "packets").alias("ul_packets"), side("downlink", "packets").alias("dl_packets"), slot(0), slot(1), slot(2),
    )


class Cutter:
    """One subscriber's open record."""

    def __init__(self, interval: int, volume: int, start: int = 0, gaps: bool = True):
        self.interval, self.volume, self.start, self.gaps = interval, volume, start, gaps
        self.seq, self.sums = 0, [0] * len(SUMS)

    def pending(self) -> int:
        return self.sums[0] + self.sums[1]

    def cut(self, reason: str, end: int) -> tuple:
        out = (self.seq, reason, self.start, end, *self.sums)
        self.seq, self.start, self.sums = self.seq + 1, end, [0] * len(SUMS)
        return out

    def add(self, tick: int, own) -> list[tuple]:
        """The records that are cut at or before a tick with this usage."""
        out = []
        if self.gaps and self.interval and self.pending() > 0 and self.start + self.interval < tick:
            out.append(self.cut("interval", self.start + self.interval))
        self.sums = [a + b for a, b in zip(self.sums, own, strict=True)]
        if self.volume and self.pending() >= self.volume:
            out.append(self.cut("volume", tick))
        elif self.interval and tick - self.start >= self.interval and self.pending() > 0:
            out.append(self.cut("interval", tick))
        return out

    def close(self, end: int | None) -> list[tuple]:
        """What is left at the end of the input."""
        return [self.cut("shutdown", end)] if self.pending() > 0 else []


def cut_records(summed: DataFrame, interval: int, volume: int, end_tick: int | None = None, gaps: bool = True, control: DataFrame | None = None) -> DataFrame:
    """Of ticks(): rows (imsi, seq, reason, start_tick, end_tick, SUMS).

    interval in ticks and volume in bytes, 0 for none. What is open at the end is cut as "shutdown", at end_tick or
    else at the subscriber's last tick; with gaps false a record is only looked at when its own events come.
    control: (imsi, tick, op); a release cuts a record behind its tick's usage even if nothing is pending, an install
    opens the subscriber at its tick, with seq from 0, unless it is active already. From a release on, until an install, usage is on no
    record: its tunnels are unknown (unbilled() counts it), and a second release does nothing.
    """
    schema = pa.schema([("imsi", pa.int64()), ("seq", pa.int64()), ("reason", pa.string()), ("start_tick", pa.int64()), ("end_tick", pa.int64()), *((c, pa.int64()) for c in SUMS)])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def finish(imsi, own, last):
        if own is None:
            return []
        out = []
        if end_tick is not None:
            if gaps and own.interval and own.pending() > 0 and own.start + own.interval <= end_tick:
                out += [own.cut("interval", own.start + own.interval)]
            last = end_tick
        return [(imsi, *r) for r in out + own.close(last)]

    def run(batches):
        imsi, own, last = None, None, None
        for b in batches:
            out = []
            for who, tick, op, *sums in zip(*(b.column(c).to_pylist() for c in ("imsi", "tick", "op", *SUMS)), strict=True):
                if who != imsi:
                    out += finish(imsi, own, last)
                    imsi, own, last = who, Cutter(interval, volume, 0, gaps), 0
                if op == "install":  # of an active session: a modification, which goes on counting
                    if own is None or (own.seq == 0 and own.pending() == 0):
                        own, last = Cutter(interval, volume, tick, gaps), tick
                    continue
                if own is None:  # released
                    continue
                if op == "release":
                    out.append((who, *own.cut("release", tick)))
                    own = None
                    continue
                out += [(who, *r) for r in own.add(tick, sums)]
                last = tick
            if out:
                yield batch(out)
        if out := finish(imsi, own, last):
            yield batch(out)

    ddl = "imsi long, seq long, reason string, start_tick long, end_tick long, " + ", ".join(f"{c} long" for c in SUMS)
    rows = summed.select("imsi", "tick", F.lit("").alias("op"), *SUMS)
    if control is not None:
        rows = rows.unionByName(control.select("imsi", F.col("tick").cast("long").alias("tick"), "op", *(F.lit(0).cast("long").alias(c) for c in SUMS)))
    # of one tick: an install, the usage, a release
    order = F.when(F.col("op") == "install", 0).when(F.col("op") == "release", 2).otherwise(1)
    return rows.repartition("imsi").sortWithinPartitions("imsi", "tick", order).mapInArrow(run, ddl)


def unbilled(summed: DataFrame, control: DataFrame) -> DataFrame:
    """Usage between a release and the next install: (imsi, packets, bytes), which counts as unknown."""
    rows = summed.select("imsi", "tick", F.lit(1).alias("place"), F.lit(None).cast("string").alias("op"), (F.col("ul_packets") + F.col("dl_packets")).alias("packets"), (F.col("ul_bytes") + F.col("dl_bytes")).alias("bytes"))
    place = F.when(F.col("op") == "install", 0).otherwise(2)
    marks = control.select("imsi", F.col("tick").cast("long").alias("tick"), place.alias("place"), "op", *(F.lit(0).cast("long").alias(c) for c in ("packets", "bytes")))
    held = F.last("op", ignorenulls=True).over(Window.partitionBy("imsi").orderBy("tick", "place").rowsBetween(Window.unboundedPreceding, 0))
    gone = rows.unionByName(marks).withColumn("held", held).where("held = 'release' and op is null")
    return gone.groupBy("imsi").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def with_buckets(records: DataFrame, ranked: DataFrame, start_ns: int, tick_ns: int, pkt_ticks: DataFrame) -> DataFrame:
    """Records with ``buckets``: array of (kind, id, bytes, aggregate), the ids as they stood when the record was cut.

    ranked: metering.buckets() of all packets; pkt_ticks: (imsi, bucket, first_tick) of each bucket.
    """
    from meterlake.functions.formats import bucket_kind, bucket_number

    order = F.struct(F.coalesce("first_line", F.lit(2**63 - 1)).alias("line"), F.coalesce("first_pkt", F.lit(-1)).alias("pkt"), "bucket", "slot", F.coalesce("first_tick", F.lit(0)).alias("tick"))
    held = ranked.join(pkt_ticks, ["imsi", "bucket"], "left").groupBy("imsi").agg(F.array_sort(F.collect_list(order)).alias("ids"))  # a subscriber has as many as there are QFIs and rating groups
    df = records.join(held, "imsi", "left")

    def known(k):
        return F.filter("ids", lambda x: (x["tick"] <= F.col("end_tick")) & (x["slot"] == k))

    df = df.withColumns({f"known{k}": known(k) for k in range(3)})

    def slot(k):
        b = F.get(F.col(f"known{k}"), F.lit(0))["bucket"]
        return F.struct(bucket_kind(b).alias("kind"), bucket_number(b).alias("id"), F.col(f"slot{k}").alias("bytes"), (F.lit(k == 2) & (F.size(f"known{k}") > 1)).alias("aggregate"))

    return df.withColumn("buckets", F.filter(F.array(slot(0), slot(1), slot(2)), lambda x: x["id"].isNotNull())).drop("ids", "known0", "known1", "known2")


def deltas(cumulative: DataFrame, *columns: str) -> DataFrame:
    """Cumulative counters by (imsi, seq) as what each record adds."""
    by = Window.partitionBy("imsi").orderBy("seq")
    return cumulative.withColumns({c: F.col(c) - F.lag(c, 1, 0).over(by) for c in columns})
