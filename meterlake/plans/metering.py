"""The metering plan: packets and sessions in, every table the reports need out. Each property is a lazy plan."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators import gy, ingest, metering, records, sessions, sketch
from meterlake.plans.config import Config
from meterlake.sources.shared import written


class Metering:
    def __init__(self, packets: DataFrame, installed: DataFrame, config: Config = Config()):
        self.packets, self.sessions, self.config = packets, installed, config

    @cached_property
    def frames(self) -> DataFrame:
        return ingest.frames(self.packets, self.config)

    @cached_property
    def tunnels(self) -> DataFrame:
        return ingest.tunnel_frames(self.frames)

    @cached_property
    def events(self) -> DataFrame:
        return ingest.meter_events(self.tunnels, self.config)

    @cached_property
    def segments(self) -> DataFrame:
        return ingest.segments(self.frames)

    @cached_property
    def gy_events(self) -> DataFrame:
        return ingest.gy_events(self.segments)

    @cached_property
    def combined(self) -> DataFrame:
        """Events summed by tunnel, direction hint and QFI: what counters, buckets and totals follow from."""
        return metering.combined(self.events)

    @cached_property
    def ticked(self) -> DataFrame:
        """combined by tick as well: what records follow from."""
        return self.ticked_from(self.config.start_ns)

    def ticked_from(self, start_ns: int) -> DataFrame:
        return metering.combined(self.events, records.tick_of(start_ns, self.config.tick_ns))

    def stored(self) -> Metering:
        """This plan with sessions and usage by tick written once: packets are decoded once for all but flows and Gy."""
        other = Metering(self.packets, written(self.sessions, "sessions"), self.config)
        other.events = self.events
        other.ticked = other.combined = written(self.ticked, "usage")
        return other

    @cached_property
    def usage(self) -> DataFrame:
        return metering.usage(self.combined)

    @cached_property
    def known(self) -> DataFrame:
        return sessions.bindings(self.sessions)

    @cached_property
    def learned(self) -> DataFrame:
        """The tunnels that aren't known, if they are to be learned: see metering.learned()."""
        return metering.learned(self.usage, self.known)

    @cached_property
    def bindings(self) -> DataFrame:
        if not self.config.learn_unknown_teids:
            return self.known
        return self.known.unionByName(self.learned.drop("first_pkt", "first_ns"))

    @cached_property
    def subscribers(self) -> DataFrame:
        """Installed subscribers, then learned ones in the order of their first packets; a learned one has one tunnel."""
        installed = sessions.subscribers(self.sessions)
        if not self.config.learn_unknown_teids:
            return installed
        down, none, zero = F.col("binding_dir") == "downlink", F.lit(None).cast("string"), F.lit(0).cast("long")
        return installed.unionByName(self.learned.select(
            "imsi", (F.lit(sessions.LEARNED_LINE) + F.col("first_pkt")).alias("first_line"), F.when(down, zero).otherwise(F.col("teid")).alias("ul_teid"),
            F.when(down, F.col("teid")).otherwise(zero).alias("dl_teid"), "rating_group", none.alias("msisdn"), none.alias("apn"), zero.alias("installs"),
        ))

    @cached_property
    def rating_groups(self) -> DataFrame:
        installed = sessions.rating_groups(self.sessions)
        if not self.config.learn_unknown_teids:
            return installed
        return installed.unionByName(self.learned.select("imsi", F.col("rating_group").alias("bucket"), (F.lit(sessions.LEARNED_LINE) + F.col("first_pkt")).alias("first_line")))

    @cached_property
    def attributed(self) -> DataFrame:
        return metering.bound(self.usage, self.bindings)

    @cached_property
    def counters(self) -> DataFrame:
        return metering.counters(self.attributed)

    @cached_property
    def buckets(self) -> DataFrame:
        return metering.buckets(self.attributed, self.rating_groups)

    @cached_property
    def flows(self) -> DataFrame:
        return metering.flows(self.events, self.bindings)

    @cached_property
    def gy_totals(self) -> DataFrame:
        return gy.reported(self.gy_events.join(sessions.subscribers(self.sessions).select("imsi"), "imsi", "left_semi"))

    @cached_property
    def crosscheck(self) -> DataFrame:
        return gy.crosscheck(self.counters, self.gy_totals)

    def slotted(self, start_ns: int | None = None) -> DataFrame:
        """Usage by tick of bound tunnels with direction and slot, for the record cutter: joined when it is summed."""
        found = self.ticked if start_ns in (None, self.config.start_ns) else self.ticked_from(start_ns)
        known = found.where("not control").join(self.bindings, "teid").withColumn("direction", metering.direction(F.col("binding_dir"), F.col("dir")))
        summed = known.withColumn("bucket", metering.bucket()).groupBy("imsi", "bucket", "tick", "direction").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
        return summed.join(self.buckets.select("imsi", "bucket", "slot"), ["imsi", "bucket"])

    def ticks(self, start_ns: int | None = None) -> DataFrame:
        return records.ticks(self.slotted(start_ns))

    def records(self, start_ns: int | None = None, end_tick: int | None = None, gaps: bool = True, control: DataFrame | None = None) -> DataFrame:
        """Usage records; ticks count from start_ns, by default the settings'. control: see records.cut_records()."""
        c = self.config
        if c.learn_unknown_teids:
            first = self.ticks(start_ns).where("imsi < 0").groupBy("imsi").agg(F.min("tick").alias("tick")).withColumn("op", F.lit("install"))
            control = first if control is None else control.select("imsi", "tick", "op").unionByName(first)
        return records.cut_records(self.ticks(start_ns), c.report_interval_ns // c.tick_ns, c.volume_threshold_bytes, end_tick, gaps, control)

    def records_with_buckets(self, start_ns: int | None = None, end_tick: int | None = None) -> DataFrame:
        start_ns = self.config.start_ns if start_ns is None else start_ns
        first = self.slotted(start_ns).groupBy("imsi", "bucket").agg(F.min("tick").alias("first_tick"))
        rating = sessions.rating_groups(self.sessions).select("imsi", "bucket", F.lit(0).cast("long").alias("installed"))
        first = first.join(rating, ["imsi", "bucket"], "left").select("imsi", "bucket", F.coalesce("installed", "first_tick").alias("first_tick"))
        return records.with_buckets(self.records(start_ns, end_tick), self.buckets, start_ns, self.config.tick_ns, first)

    def state(self, start_ns: int | None = None, latency: DataFrame | None = None, value: str = "latency_ns") -> DataFrame:
        """One row with every counter and gauge of the reports, each computed; latency: rows with a column ``value``."""
        one = ingest.totals(self.frames, self.segments, self.config).crossJoin(metering.totals(self.combined, self.attributed))
        cut = self.records(start_ns).agg(F.count("*").alias("records_emitted")).withColumn("records_written", F.col("records_emitted"))
        found = self.flows.agg(F.count("*").alias("flows_active"))
        told = self.gy_totals.agg(F.coalesce(F.sum("gy_reported_octets"), F.lit(0)).cast("long").alias("gy_reported_octets"))
        active = self.subscribers.agg(F.count("*").alias("subscribers_active")).crossJoin(self.bindings.agg(F.count("*").alias("teids_bound")))
        if latency is None:
            latency, value = self.sessions.select(F.lit(None).cast("long").alias("latency_ns")).limit(0), "latency_ns"
        for other in (cut, found, told, active, sketch.summary(latency, value)):
            one = one.crossJoin(other)  # one row each
        zero = F.lit(0).cast("long")  # nothing is full, evicted or dropped here
        one = one.withColumns({"teid_bind_failures": zero, "flow_evictions": zero, "records_dropped": zero})
        return one.withColumn("not_our_traffic", F.col("not_gtpu_port") + F.col("non_ip"))
