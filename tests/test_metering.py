from pyspark.sql import functions as F

from meterlake.operators import checks, ingest, metering, records, sessions
from meterlake.plans.config import Config
from meterlake.plans.metering import Metering
from meterlake.sources import synth as s

IMSI = 310150000000001
EVENT = "pkt_no long, ts_ns long, teid long, control boolean, bytes long, dir string, has_qfi boolean, qfi int, src_ip binary, dst_ip binary, src_port long, dst_port long, proto long, ip_version int"


def events(spark, rows):
    """rows: dicts with any of teid, bytes, dir, qfi, control, port, ts."""
    out = []
    for i, r in enumerate(rows):
        port = r.get("port")
        flow = (b"\x0a\0\0\1", b"\x0a\0\0\2", port, 80, 17, 4) if port else (None,) * 6
        out.append((i, r.get("ts", 1000 * i), r.get("teid", 100), r.get("control", False), r.get("bytes", 100), r.get("dir", "unknown"), "qfi" in r, r.get("qfi"), *flow))
    return spark.createDataFrame(out, EVENT)


def session_table(spark, *rows):
    """rows: (imsi, ul, dl, rating_group)."""
    return spark.createDataFrame([(i, *r, "", "") for i, r in enumerate(rows)], "line_no long, imsi long, ul_teid long, dl_teid long, rating_group long, msisdn string, apn string")


def plan(spark, rows, table, config=Config()):
    m = Metering(None, session_table(spark, *table), config)
    m.events = events(spark, rows)
    return m


BASE = [(IMSI, 100, 200, 10)]


def test_bindings(spark):
    assert sorted((r.teid, r.binding_dir) for r in sessions.bindings(session_table(spark, *BASE)).collect()) == [(100, "uplink"), (200, "downlink")]
    invalid = session_table(spark, (0, 1, 2, 3), (5, 0, 0, 1), (6, 0, 9, 1))
    assert [(r.imsi, r.teid) for r in sessions.bindings(invalid).collect()] == [(6, 9)]


def test_modification_moves_a_tunnel_and_the_last_claim_wins(spark):
    moved = session_table(spark, (1, 100, 200, 10), (1, 300, 200, 20), (2, 200, 400, 5))
    assert sorted((r.teid, r.imsi, r.binding_dir, r.rating_group) for r in sessions.bindings(moved).collect()) == [(200, 2, "uplink", 5), (300, 1, "uplink", 20), (400, 2, "downlink", 5)]
    assert [(r.imsi, r.sub) for r in sessions.numbered(sessions.subscribers(moved)).orderBy("sub").collect()] == [(1, 0), (2, 1)]


def test_modification_over_time(spark):
    control = spark.createDataFrame([(0, 0, "install", 1, 100, 200, 10), (1, 1, "install", 1, 300, 200, 10)], "ctl_no long, pkt_no long, op string, imsi long, ul_teid long, dl_teid long, rating_group long")
    found = sessions.bind_at(events(spark, [{"bytes": 500}, {"bytes": 700}, {"bytes": 900, "teid": 300}]), sessions.timeline(control)).orderBy("pkt_no").collect()
    assert [(r.imsi, r.incarnation) for r in found] == [(1, 0), (None, None), (1, 0)] and sum(r.bytes for r in found if r.imsi) == 1400


def test_release_and_return(spark):
    control = spark.createDataFrame([(0, 0, "install", 1, 100, 0, 1), (1, 1, "release", 1, 0, 0, 0), (2, 2, "release", 1, 0, 0, 0), (3, 3, "install", 1, 100, 0, 1)], "ctl_no long, pkt_no long, op string, imsi long, ul_teid long, dl_teid long, rating_group long")
    assert [(r.imsi, r.pkt_no) for r in sessions.releases(control).collect()] == [(1, 1)]
    found = sessions.bind_at(events(spark, [{}, {}, {}, {}]), sessions.timeline(control)).orderBy("pkt_no").collect()
    assert [r.incarnation for r in found] == [0, None, None, 1]


def test_direction_comes_from_the_binding(spark):
    c = plan(spark, [{"bytes": 500, "dir": "downlink"}, {"bytes": 1500, "teid": 200, "dir": "uplink"}], BASE).counters.first()
    assert (c.ul_bytes, c.ul_packets, c.dl_bytes, c.dl_packets) == (500, 1, 1500, 1)


def test_unknown_and_control(spark):
    m = plan(spark, [{"teid": 999, "bytes": 1000}, {"control": True, "bytes": 0}, {"ts": 5}], BASE)
    t = metering.totals(m.combined, m.attributed).first()
    assert (t.unknown_teid_events, t.unknown_teid_bytes, t.control_pdus, t.ul_bytes, t.bytes, t.events, t.last_event_ns) == (1, 1000, 1, 100, 1100, 3, 5)
    assert [tuple(r) for r in metering.unknown_by_teid(m.attributed).collect()] == [(999, 1, 1000)]


def test_learning(spark):
    m = plan(spark, [{"teid": 4242, "bytes": 700, "dir": "downlink"}, {"teid": 4242, "bytes": 1, "dir": "uplink"}], BASE, Config(learn_unknown_teids=True))
    c = m.counters.first()
    assert (c.imsi, c.dl_bytes, c.dl_packets, c.ul_bytes) == (-4242, 701, 2, 0)
    assert metering.totals(m.combined, m.attributed).first().unknown_teid_events == 0


def test_each_unknown_tunnel_is_a_subscriber_of_its_own(spark):
    m = plan(spark, [{"teid": 7, "bytes": 100, "ts": 40}, {"teid": 9, "bytes": 900, "ts": 50}, {"teid": 7, "bytes": 1, "qfi": 3, "ts": 60}], BASE, Config(learn_unknown_teids=True, tick_ns=1))
    assert sorted((r.imsi, r.ul_bytes) for r in m.counters.collect()) == [(-9, 900), (-7, 101)]
    assert [(r.imsi, r.sub, r.ul_teid, r.dl_teid) for r in sessions.numbered(m.subscribers).orderBy("sub").collect()] == [(IMSI, 0, 100, 200), (-7, 1, 7, 0), (-9, 2, 9, 0)]
    assert sorted((r.imsi, r.slot, r.bytes) for r in metering.slots(m.buckets).where("imsi < 0").collect()) == [(-9, 0, 900), (-7, 0, 100), (-7, 1, 1)]
    assert sorted((r.imsi, r.reason, r.start_tick, r.end_tick, r.ul_bytes) for r in m.records().collect()) == [(-9, "shutdown", 50, 50, 900), (-7, "shutdown", 40, 60, 101)]


def test_usage_after_a_release_is_unknown(spark):
    m = plan(spark, [{"bytes": 700, "ts": 5}, {"bytes": 700, "ts": 60}, {"bytes": 9, "ts": 90}], BASE, Config(report_interval_ns=0, volume_threshold_bytes=0, tick_ns=1))
    control = spark.createDataFrame([(IMSI, 0, "install"), (IMSI, 50, "release"), (IMSI, 70, "release"), (IMSI, 80, "install")], "imsi long, tick long, op string")
    got = sorted((r.reason, r.seq, r.start_tick, r.end_tick, r.ul_bytes) for r in m.records(control=control).collect())
    assert got == [("release", 0, 0, 50, 700), ("shutdown", 0, 80, 90, 9)]
    assert [tuple(r) for r in records.unbilled(m.ticks(), control).collect()] == [(IMSI, 1, 700)]
    again = spark.createDataFrame([(IMSI, 0, "install"), (IMSI, 50, "install")], "imsi long, tick long, op string")
    assert [(r.seq, r.start_tick, r.ul_bytes) for r in m.records(control=again).collect()] == [(0, 0, 1409)]


def test_numbering_is_exact_over_many_partitions(spark):
    n = 3_000_000
    rows = spark.range(n, numPartitions=7).select((n - F.col("id") * 7 % n).alias("imsi"), (F.col("id") * 5 + F.when(F.col("id") > n // 2, 1 << 33).otherwise(0)).alias("first_line"))
    got = sessions.numbered(rows).agg(F.count("*").alias("n"), F.count_distinct("sub").alias("d"), F.min("sub").alias("low"), F.max("sub").alias("high")).first()
    assert tuple(got) == (n, n, 0, n - 1)
    want = F.when(F.col("id") > n // 2, F.col("id")).otherwise(F.col("id"))
    place = rows.withColumn("id", F.when(F.col("first_line") >= 1 << 33, (F.col("first_line") - (1 << 33)) / 5).otherwise(F.col("first_line") / 5).cast("long"))
    assert sessions.numbered(place).where(F.col("sub") != want).count() == 0


def ids(m):
    return sorted((r.slot, r.bucket & 0x7FFFFFFF, r.bytes, r.aggregated) for r in metering.slots(m.buckets).collect())


def test_buckets(spark):
    assert ids(plan(spark, [{}, {"bytes": 200, "qfi": 9}], [(IMSI, 100, 200, 5)])) == [(0, 5, 100, False), (1, 9, 200, False)]
    assert ids(plan(spark, [{"bytes": 10, "qfi": q} for q in (1, 2, 3, 4)], [(IMSI, 100, 200, 1)])) == [(0, 1, 0, False), (1, 1, 10, False), (2, 2, 30, True)]
    assert ids(plan(spark, [], [(IMSI, 100, 200, 1)])) == [(0, 1, 0, False)]


def test_flows(spark):
    m = plan(spark, [{"port": 5}] * 5 + [{"port": 6, "teid": 200}, {}, {"teid": 999, "port": 9}], BASE)
    got = {r.src_port: r for r in m.flows.collect()}
    assert len(got) == 3 and (got[5].bytes, got[5].packets, got[5].direction) == (500, 5, "uplink") and got[None].flow_key == 1 and got[6].direction == "downlink"
    assert [r.bytes for r in metering.top(m.flows, 2, "bytes", "flow_key").collect()] == [500, 100]


def cut(spark, rows, interval, volume, end=None):
    m = plan(spark, rows, BASE, Config(report_interval_ns=interval, volume_threshold_bytes=volume, tick_ns=1))
    return [(r.seq, r.reason, r.ul_bytes, r.dl_bytes) for r in m.records(0, end).orderBy("imsi", "seq").collect()]


def test_records(spark):
    assert cut(spark, [{"ts": 500, "bytes": 1000}, {"ts": 3000, "bytes": 2500, "teid": 200}], 1000, 0, 4000) == [(0, "interval", 1000, 0), (1, "interval", 0, 2500)]
    assert cut(spark, [{"ts": 10 + i, "bytes": 1000} for i in range(20)], 0, 10_000) == [(0, "volume", 10_000, 0), (1, "volume", 10_000, 0)]
    assert cut(spark, [{"ts": 1}, {"ts": 2}], 0, 0) == [(0, "shutdown", 200, 0)]
    assert cut(spark, [{"ts": 1, "bytes": 0}], 0, 0) == []


def test_cutter_against_a_poll_at_every_tick():
    import random

    rng = random.Random(11)
    for _ in range(60):
        interval, volume = rng.choice((0, 5, 9)), rng.choice((0, 300, 900))
        used = {t: rng.randint(1, 400) for t in sorted(rng.sample(range(1, 80), rng.randint(1, 30)))}
        own, got = records.Cutter(interval, volume), []
        for t, b in used.items():
            got += [(r[1], r[3], r[4]) for r in own.add(t, (b, 0, 1, 0, b, 0, 0))]
        want, start, pending = [], 0, 0
        for t in range(1, max(used) + 1):
            pending += used.get(t, 0)
            if pending and volume and pending >= volume:
                want.append(("volume", t, pending))
            elif pending and interval and t - start >= interval:
                want.append(("interval", t, pending))
            else:
                continue
            start, pending = t, 0
        assert got == want


def test_golden_traffic(spark):
    """A generated capture with its ground truth: every subscriber to the byte, a charging report for each, no gap."""
    t = s.generate(2000, 20, 7)
    table = spark.createDataFrame([(n, i, u, d, g, m, a) for n, i, u, d, g, m, a in t.sessions], "line_no long, imsi long, ul_teid long, dl_teid long, rating_group long, msisdn string, apn string")
    packets = spark.createDataFrame([(i, ts, n, 1, x) for i, (ts, n, x) in enumerate(t.packets)], "pkt_no long, ts_ns long, orig_len long, link_type int, data binary")
    m = Metering(packets, table, Config(report_interval_ns=0))
    assert {r.imsi: {k: r[k] for k in ("ul_bytes", "dl_bytes", "ul_packets", "dl_packets")} for r in m.counters.collect()} == {i: e for i, e in t.expected.items() if e["ul_packets"] + e["dl_packets"]}
    one = ingest.totals(m.frames, m.segments).first()
    assert (one.gtpu_gpdus, one.gtpu_control, one.not_gtpu_port, one.diameter_messages, one.gtpu_parse_errors, one.diameter_parse_errors, one.gy_events) == (2000, 2, 100, 40, 0, 0, 40)
    assert {r.difference for r in m.crosscheck.collect()} == {0}
    found = m.records(t.packets[0][0])
    assert all(r.gapless for r in checks.rollup(found).collect()) and checks.mismatches(m.counters, checks.rollup(found), "imsi", "ul_bytes", "dl_bytes").count() == 0
    assert {r.outcome: r.frames for r in ingest.outcomes(m.frames, m.tunnels, m.segments).collect()} == {"metered": 2000, "gtpu-control": 2, "gy-control": 40, "not-our-traffic": 100}
    totals = {r.teid: r.bytes for r in checks.teid_totals(sessions.subscribers(table), found).collect()}
    assert all(totals.get(u, 0) == t.expected[i]["ul_bytes"] and totals.get(d, 0) == t.expected[i]["dl_bytes"] for _, i, u, d, *_ in t.sessions)


def test_gy(spark):
    rows = [(0, 5, 1, True, True, 9500), (1, 6, 1, True, False, 1), (2, 7, 0, False, True, 3), (3, 8, 1, True, True, 9500)]
    gy_events = spark.createDataFrame(rows, "pkt_no long, ts_ns long, imsi long, has_imsi boolean, has_used boolean, used_total_octets long").withColumns({"cc_request_type": F.lit(2), "cc_request_number": F.lit(0), "rating_group": F.lit(1), "is_request": F.lit(True)})
    from meterlake.operators import gy

    assert [(r.gy_reported_octets, r.gy_reports, r.gy_last_ns) for r in gy.reported(gy_events).collect()] == [(19000, 2, 8)]
    counters = spark.createDataFrame([(1, 4000, 6000), (2, 1, 1)], "imsi long, ul_bytes long, dl_bytes long")
    assert [(r.difference, r.reports) for r in gy.crosscheck(counters, gy.reported(gy_events, distinct=True)).collect()] == [(500, 1)]


def test_frames_are_charged_by_their_inner_length(spark):
    frames = [s.tunnel_frame(0x1111 if i % 2 == 0 else 0x2222, 100 + i) for i in range(50)] + [s.tunnel_frame(0x1111, 800)[:96], s.ethernet(s.ipv4(s.udp(b"x", 80, 80))), s.ethernet(b"", 0x0806), s.ethernet(s.ipv4(s.udp(s.gtpu(b"\x60\x01\x02", 0x1111))))]
    packets = spark.createDataFrame([(i, i, len(f), 1, f) for i, f in enumerate(frames)], "pkt_no long, ts_ns long, orig_len long, link_type int, data binary")
    m = Metering(packets, session_table(spark, (1, 0x1111, 0x2222, 1)))
    c = m.counters.first()
    assert (c.ul_packets, c.dl_packets) == (26, 25) and c.ul_bytes == sum(128 + i for i in range(0, 50, 2)) + 3 and c.dl_bytes == sum(128 + i for i in range(1, 50, 2))
    t = ingest.totals(m.frames, m.segments).first()
    assert (t.gtpu_parse_errors, t.truncated_frames, t.not_gtpu_port, t.non_ip, t.inner_parse_errors) == (1, 1, 1, 1, 1)
    captured = Metering(packets, m.sessions, Config(meter_inner_ip_length=False)).counters.first()
    assert captured.ul_bytes == c.ul_bytes
