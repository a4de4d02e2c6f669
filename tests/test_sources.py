import json

import pytest
from pyspark.sql import functions as F

from meterlake.operators import sessions as ops
from meterlake.plans.config import Config
from meterlake.plans.metering import Metering
from meterlake.report import documents
from meterlake.sources import dissector, pcap, records, sessions, synth


def rows(n=3):
    return [(1_700_000_000_123_456_789 + i * 1000, 60, bytes([i]) * 10) for i in range(n)]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("nano", [True, False])
def test_captures(order, nano):
    data = pcap.write_capture(rows(), 101, nano, order)
    got = list(pcap.read_capture(data))
    assert [(n, ts, length, link, x) for n, ts, length, link, x in got] == [(i, ts if nano else ts // 1000 * 1000, 60, 101, x) for i, (ts, _, x) in enumerate(rows())]
    assert pcap.malformed(data) == 0 and len(list(pcap.read_capture(data[:-1]))) == 2 and pcap.malformed(data[:-1]) == 1


def test_no_captures():
    for x in (b"", b"\x0a\x0d\x0d\x0a" + b"\0" * 40, b"\xd4\xc3\xb2\xa1"):
        with pytest.raises(pcap.NotACapture):
            list(pcap.read_capture(x))


def test_data_source_and_loader(spark, tmp_path):
    pcap.register(spark)
    for k in range(2):
        (tmp_path / f"c{k}.pcap").write_bytes(pcap.write_capture(rows()))
    a = spark.read.format("pcap").load(str(tmp_path))
    b = pcap.packets(spark, f"{tmp_path}/*.pcap")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and [r.pkt_no % pcap.PER_FILE for r in a.orderBy("pkt_no").collect()] == [0, 1, 2, 0, 1, 2]
    assert pcap.replayed(a.where(f"pkt_no < {pcap.PER_FILE}"), 3).select("pkt_no").distinct().count() == 9
    a.coalesce(1).write.format("pcap").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("pcap").load(str(tmp_path / "out")).count() == 6
    with pytest.raises(pcap.NotACapture):
        pcap.replayed(a.limit(0), 2)


def test_overwriting_and_counting_what_is_cut(spark, tmp_path):
    pcap.register(spark)
    df = spark.createDataFrame([(i, *r[:2], 1, r[2]) for i, r in enumerate(rows())], pcap.SCHEMA)
    for _ in range(2):
        df.coalesce(1).write.format("pcap").mode("overwrite").save(str(tmp_path / "out"))
    assert spark.read.format("pcap").load(str(tmp_path / "out")).count() == 3
    (tmp_path / "a.pcap").write_bytes(pcap.write_capture(rows()))
    (tmp_path / "b.pcap").write_bytes(pcap.write_capture(rows())[:-3])
    assert sorted((r.path[-6:], r.packets, r.malformed_records) for r in pcap.checked(spark, f"{tmp_path}/*.pcap").collect()) == [("a.pcap", 3, 0), ("b.pcap", 2, 1)]
    for x in (0, -1):
        with pytest.raises(ValueError):
            pcap.replayed(df, x)


def test_stream_of_captures_reads_each_file_once(spark, tmp_path):
    """Files land one after another, the later one under a smaller name; a restart goes on behind the last one."""
    pcap.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def land(name, n):
        (tmp_path / name).write_bytes(pcap.write_capture(rows(n)))
        (tmp_path / name).rename(source / name)

    def run():
        stream = spark.readStream.format("pcap").option("maxFilesPerTrigger", 1).load(str(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    land("m.pcap", 3)
    land("n.pcap", 2)
    run()
    assert spark.read.parquet(out).count() == 5
    land("a.pcap", 4)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 9 and sorted((r.k, r.n) for r in got.groupBy((F.col("pkt_no") / pcap.PER_FILE).cast("long").alias("k")).agg(F.count("*").alias("n")).collect()) == [(0, 3), (1, 2), (2, 4)]


TEXT = """# comment
imsi,ul_teid,dl_teid,rating_group,msisdn,apn
310150000000001,100,200,10,15551234567,internet
 310150000000003 , 0x1000 ,0x2000, 5

not-a-number,1,2,3
310150000000005
310150000000006,4294967296,2,3
0,1,2,3
310150000000007,7,8,bad
310150000000008,0,0,1
310150000000009,5,
"""


def test_sessions(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(TEXT)
    got = sessions.read_sessions(spark, str(path)).orderBy("line_no").collect()
    assert [(r.imsi, r.ul_teid, r.dl_teid, r.rating_group, r.apn) for r in got] == [(310150000000001, 100, 200, 10, "internet"), (310150000000003, 4096, 8192, 5, ""), (310150000000007, 7, 8, 0, "")]
    assert sessions.skipped(spark, str(path)) == 6
    back = documents.csv_sessions(sessions.read_sessions(spark, str(path)))
    back.coalesce(1).write.text(str(tmp_path / "back"))
    again = sessions.read_sessions(spark, str(tmp_path / "back")).drop("line_no")
    assert sorted(again.collect()) == sorted(sessions.read_sessions(spark, str(path)).drop("line_no").collect())


def test_dissector(spark):
    text = ["eth:ethertype:ip:udp:gtp:ip:udp:data|0x10|200,128|", "eth:ip:udp:gtp:ip|16|100,72|", "eth:ip:udp:gtp:ipv6:udp|17|100|60", "eth:ip:udp:gtp|18|100|", "eth:ip:udp|19|90|", "eth:ip:udp:gtp:ip||90|", "eth:ip:udp:gtp:ip|x|90|", "eth:ip:udp:gtp:ip|20||", ""]
    got = dissector.teid_totals(spark.createDataFrame([(x,) for x in text], "value string")).collect()
    assert {r.teid: r.bytes for r in got} == {16: 200, 17: 100}


def test_records_round_trip(spark, tmp_path):
    t = synth.generate(300, 5, 3)
    table = spark.createDataFrame(t.sessions, "line_no long, imsi long, ul_teid long, dl_teid long, rating_group long, msisdn string, apn string")
    packets = spark.createDataFrame([(i, ts, n, 1, x) for i, (ts, n, x) in enumerate(t.packets)], "pkt_no long, ts_ns long, orig_len long, link_type int, data binary")
    start = t.packets[0][0]
    m = Metering(packets, table, Config(report_interval_ns=100_000, volume_threshold_bytes=0, tick_ns=10_000))
    lines = documents.record_lines(m.records_with_buckets(start), ops.numbered(ops.subscribers(table)), start, 10_000)
    documents.write_records(lines, str(tmp_path / "r"))
    one = json.loads(lines.first().value)
    assert list(one) == ["ts", "imsi", "sub", "seq", "reason", "ul_bytes", "dl_bytes", "ul_pkts", "dl_pkts", "interval_ns", "buckets"] and isinstance(one["imsi"], str)
    back = records.read_records(spark, str(tmp_path / "r")).groupBy("imsi").agg(F.sum("ul_bytes").alias("u"), F.sum("dl_bytes").alias("d")).collect()
    assert {r.imsi: (r.u, r.d) for r in back} == {i: (e["ul_bytes"], e["dl_bytes"]) for i, e in t.expected.items()}
    bytes_ = [sum(b["bytes"] for b in json.loads(r.value)["buckets"]) - json.loads(r.value)["ul_bytes"] - json.loads(r.value)["dl_bytes"] for r in lines.collect()]
    assert set(bytes_) == {0}


def test_checksum():
    assert synth.checksum(synth.ipv4(b"")[:20]) == 0


def test_sessions_of_several_files_follow_their_names(spark, tmp_path):
    """The last install of a TEID holds, by file name and line, whatever the files' sizes."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for k, n in enumerate((5, 400, 60)):
            (tmp_path / f"s{k}.csv").write_text("".join(f"{10_000 * k + i + 1},{100 + i},{5000 + i},{k}\n" for i in range(n)))
        got = sessions.read_sessions(spark, str(tmp_path))
        assert [r.imsi for r in got.orderBy("line_no").collect()] == [10_000 * k + i + 1 for k, n in enumerate((5, 400, 60)) for i in range(n)]
        assert {r.imsi for r in ops.bindings(got).where("teid < 160 and teid >= 100").collect()} == {20_001 + i for i in range(60)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
