"""Usage records from a stream of packets: the same decoding and the same fold, with the open record as keyed state.

Events of one tick may arrive in several batches, so a subscriber's last tick stays open in its state until a later one is
seen. Packets have to arrive in the order of their ticks; closing the books (close=True) cuts what is left.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterlake.operators import ingest, metering
from meterlake.operators.records import SUMS, Cutter
from meterlake.plans.config import Config

OUT = "imsi long, seq long, reason string, start_tick long, end_tick long, " + ", ".join(f"{c} long" for c in SUMS)


class RecordCutter(StatefulProcessor):
    def __init__(self, interval: int, volume: int):
        self.interval, self.volume = interval, volume

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "value string")

    def load(self) -> tuple[Cutter, dict[int, list[int]]]:
        own = Cutter(self.interval, self.volume)
        if not self.state.exists():
            return own, {}
        seq, start, sums, open_ = json.loads(self.state.get()[0])
        own.seq, own.start, own.sums = seq, start, sums
        return own, {int(k): v for k, v in open_.items()}

    def handleInputRows(self, key, rows, timerValues):
        own, open_ = self.load()
        closing = False
        for pdf in rows:
            for tick, *sums in pdf[["tick", *SUMS]].itertuples(index=False):
                if tick < 0:
                    closing = True  # the mark at the end of the input
                    continue
                had = open_.setdefault(int(tick), [0] * len(SUMS))
                open_[int(tick)] = [a + int(b) for a, b in zip(had, sums, strict=True)]
        out, last = [], max(open_, default=0)
        for tick in sorted(open_):
            if tick < last or closing:
                out += own.add(tick, open_.pop(tick))
        if closing:
            out += own.close(last)
        self.state.update((json.dumps([own.seq, own.start, own.sums, open_]),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["imsi", "seq", "reason", "start_tick", "end_tick", *SUMS])

    def close(self) -> None:
        pass


def usage_ticks(packets: DataFrame, bindings: DataFrame, slots: DataFrame | None, start_ns: int, config: Config = Config()) -> DataFrame:
    """A stream of packets as (imsi, tick, SUMS) rows, one a packet: decoding, a join with the static bindings, no shuffle."""
    events = ingest.meter_events(ingest.tunnel_frames(ingest.frames(packets, config)), config).where("not control")
    known = events.select("ts_ns", "teid", "dir", "bytes", "has_qfi", "qfi").join(bindings, "teid").withColumn("direction", metering.direction(F.col("binding_dir"), F.col("dir")))
    tick = F.call_function("div", F.col("ts_ns") - F.lit(start_ns) + F.lit(config.tick_ns - 1), F.lit(config.tick_ns))
    up = F.col("direction") == "uplink"
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    return known.select("imsi", tick.alias("tick"), F.when(up, F.col("bytes")).otherwise(zero).alias("ul_bytes"), F.when(up, zero).otherwise(F.col("bytes")).alias("dl_bytes"), F.when(up, one).otherwise(zero).alias("ul_packets"), F.when(up, zero).otherwise(one).alias("dl_packets"), *(zero.alias(f"slot{k}") for k in range(3)))


def records(ticks: DataFrame, config: Config = Config()) -> DataFrame:
    """usage_ticks() of a stream, and a row with tick -1 a subscriber to close it, as records; needs the RocksDB state store."""
    return ticks.groupBy("imsi").transformWithStateInPandas(
        RecordCutter(config.report_interval_ns // config.tick_ns, config.volume_threshold_bytes), outputStructType=OUT, outputMode="append", timeMode="None"
    )


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
