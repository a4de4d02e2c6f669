import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions import diameter as d
from meterlake.functions import formats, ip
from meterlake.functions.gtpu import gtpu
from meterlake.operators import ingest
from meterlake.sources import synth as s


def packets(spark, frames, link=1):
    return spark.createDataFrame([(i, 1000 * i, len(f), link, bytes(f)) for i, f in enumerate(frames)], "pkt_no long, ts_ns long, orig_len long, link_type int, data binary")


def decoded(spark, pdus):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pdus)], "i int, pdu binary")
    return [r.asDict() for r in gtpu(df, "pdu").orderBy("i").collect()]


def test_gtpu_headers(spark):
    plain, qfi, down = s.gtpu(b"abcd", 7), s.gtpu(b"xy", 0xFFFFFFFF, qfi=9), s.gtpu(b"", 1, qfi=63, uplink=False)
    rqi = bytearray(down)
    rqi[14] |= 0x40
    two = s.gtpu(b"p", 5, links=((0x40, b"\0\x08"), (0x85, b"\x10\x03")))
    again = s.gtpu(b"p", 5, qfi=1, links=((0x85, b"\0\x07"),))
    padded = s.gtpu(b"abc", 3, seq=513) + b"\0" * 9
    got = decoded(spark, [plain, qfi, down, bytes(rqi), two, again, padded, s.gtpu(b"", 2, 254)])
    assert [r["gtpu_status"] for r in got] == ["ok"] * 8
    assert [r["gtpu_teid"] for r in got] == [7, 0xFFFFFFFF, 1, 1, 5, 5, 3, 2]
    assert [r["gtpu_qfi"] for r in got] == [None, 9, 63, 63, 3, 7, None, None]
    assert [r["gtpu_pdu_type"] for r in got] == [None, 1, 0, 0, 1, 0, None, None]
    assert [r["gtpu_rqi"] for r in got] == [False, False, False, True, False, False, False, False]
    assert [bytes(r["gtpu_payload"]) for r in got] == [b"abcd", b"xy", b"", b"", b"p", b"p", b"abc", b""]
    assert (got[6]["gtpu_seq"], got[6]["gtpu_has_seq"], got[6]["gtpu_header_len"], got[4]["gtpu_ext_count"]) == (513, True, 12, 2)


def test_gtpu_rejects(spark):
    whole = s.gtpu(b"payload", 9, qfi=5, seq=1)
    assert {r["gtpu_status"] for r in decoded(spark, [whole[:n] for n in range(len(whole))])} == {"truncated"}
    ext = lambda first, area: b"\x34\xff" + (4 + len(area)).to_bytes(2) + b"\0\0\0\1\0\0\0" + bytes([first]) + area
    link = b"\x01\0\0\x40"
    cases = {
        b"\x50" + whole[1:]: "bad-version", b"\x20" + whole[1:]: "not-gtpu", b"\x32\xff\0\x02\0\0\0\1ab": "bad-length", ext(0x40, b"\0\0\0\0"): "bad-ext-header", ext(0x40, b"\x02\0\0\0"): "truncated",
        ext(0x40, link): "truncated", ext(0x40, link * 15 + b"\x01\0\0\0"): "ok", ext(0x40, link * 16 + b"\x01\0\0\0"): "ext-chain-too-long",
    }
    assert [r["gtpu_status"] for r in decoded(spark, cases)] == list(cases.values())


def inner(spark, frames, link=1):
    df = ip.ethernet(ip.strip_link(packets(spark, frames, link)), "eth").withColumn("packet", F.coalesce("l3", "eth_payload"))
    return [r.asDict() for r in ip.ip(df, "packet", "o_").orderBy("pkt_no").collect()]


def test_ethernet_and_ipv4(spark):
    u = s.udp(b"hello", 1, 2)
    frames = [
        s.ethernet(s.ipv4(u)), s.ethernet(s.ipv4(u), tags=(5,)), s.ethernet(s.ipv4(u), tags=(5, 6)), s.ethernet(s.ipv4(u), tags=(5, 6, 7)), s.ethernet(s.ipv4(u), 0x1234),
        s.ethernet(s.ipv4(u, options=b"\1" * 8)), s.ethernet(s.ipv4(u, field_=0x2000)), s.ethernet(s.ipv4(u, field_=0x0010)), s.ethernet(s.ipv4(s.tcp(b"tt", 9, 8, b"\1" * 12), 6)), s.ethernet(s.ipv4(s.sctp(b"sss", 7, 6), 132)),
        s.ethernet(s.ipv4(u, total=1000)), s.ethernet(s.ipv4(u, total=24)), s.ethernet(b"\x45" + b"\0" * 10), s.ethernet(b""), b"\0" * 13, s.ethernet(s.ipv4(u, total=10)), s.ethernet(b"\x81\0") [:14] + b"", s.ethernet(s.ipv4(b"", 1)),
    ]
    got = inner(spark, frames)
    assert [r["eth_vlan_tags"] for r in got[:5]] == [0, 1, 2, 2, 0]
    assert [r["o_valid"] for r in got] == [True, True, True, False, True, True, True, True, True, True, True, True, False, False, False, False, False, True]
    assert [(r["o_src_port"], r["o_dst_port"]) for r in got[4:12]] == [(1, 2), (1, 2), (1, 2), (None, None), (9, 8), (7, 6), (1, 2), (None, None)]
    assert [r["o_payload"] and bytes(r["o_payload"]) for r in got[4:11]] == [b"hello", b"hello", b"hello", None, b"tt", b"sss", b"hello"]
    assert [r["o_fragmented"] for r in got[5:8]] == [False, True, True] and got[10]["o_total_len"] == 1000


def test_tcp_with_a_bad_offset_keeps_its_ports(spark):
    t = bytearray(s.tcp(b"x", 9, 8))
    t[12] = 0x40
    r = inner(spark, [s.ethernet(s.ipv4(bytes(t), 6))])[0]
    assert (r["o_src_port"], r["o_ports_valid"], r["o_payload"]) == (9, True, None)


def test_ipv6_extensions(spark):
    u = s.udp(b"six", 11, 22)
    hop = lambda nxt, body: bytes([nxt, 0]) + b"\0" * 6 + body
    frag = lambda nxt, field, body: bytes([nxt, 0]) + field.to_bytes(2) + b"\0" * 4 + body
    ah = bytes([17, 1]) + b"\0" * 10 + u
    many = u
    for k in range(9):
        many = hop(17 if k == 0 else 0, many)
    cases = [
        (u, 17), (hop(17, u), 0), (hop(43, hop(17, u)), 60), (ah, 51), (frag(17, 0, u), 44), (frag(17, 1, u), 44), (frag(17, 0x10, u), 44), (b"\x11\xff" + b"\0" * 6 + u, 0), (b"\x11\0", 0), (many, 0), (b"icmp", 58),
    ]
    got = inner(spark, [s.ethernet(s.ipv6(p, n), 0x86DD) for p, n in cases])
    assert [r["o_proto"] for r in got] == [17, 17, 17, 17, 17, 17, 17, 0, 0, 0, 58]
    assert [r["o_src_port"] for r in got] == [11, 11, 11, 11, 11, 11, None, None, None, None, None]
    assert [r["o_fragmented"] for r in got[4:7]] == [False, True, True] and [r["o_header_len"] for r in got[:8]] == [40, 48, 56, 52, 48, 48, 48, 40]
    assert all(r["o_valid"] for r in got) and got[0]["o_total_len"] == 40 + len(u)


def test_link_types(spark):
    p = s.ipv4(s.udp(b"r", 1, 2))
    for link, data in ((101, p), (228, p), (113, b"\0" * 16 + p)):
        assert inner(spark, [data], link)[0]["o_dst_port"] == 2
    assert ingest.frames(packets(spark, [p], 9999)).count() == 0 and ingest.frames(packets(spark, [b"\0" * 16], 113)).count() == 0


def test_formats(spark):
    six = bytes.fromhex("20010db8000000000000000000000001")
    row = spark.createDataFrame([(b"\x0a\x2d\x00\xff", six, None)], "a binary, b binary, c binary").select(*(ip.format_ip(F.col(c)) for c in "abc")).first()
    assert tuple(row) == ("10.45.0.255", "2001:db8:0:0:0:0:0:1", "-")

    def fnv(data):
        h = 1469598103934665603
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return h - (1 << 64 if h >> 63 else 0)

    df = spark.createDataFrame([(b"\x0a\x2d\x00\x01", b"\x5d\xb8\xd8\x22", 20000, 443, 17, 4), (six, six[::-1], None, None, 58, 6)], "s binary, d binary, p long, q long, n long, v int")
    got = [r[0] for r in df.select(ip.flow_key(*(F.col(c) for c in "sdpqnv"))).collect()]
    assert got == [fnv(b"\x0a\x2d\x00\x01\x5d\xb8\xd8\x22" + (20000).to_bytes(2) + (443).to_bytes(2) + b"\x11\x04"), fnv(six + six[::-1] + b"\0\0\0\0" + b"\x3a\x06")]
    values = [("12", 12), ("0x1F", 31), ("0X1f", 31), ("", None), ("0x", None), ("1x", None), ("99999999999999999999", None), ("0xffffffffffffffff", None)]
    assert [r[0] for r in spark.createDataFrame([(v,) for v, _ in values], "t string").select(formats.unsigned(F.col("t"))).collect()] == [x for _, x in values]
    assert spark.range(1).select(formats.rfc3339(F.lit(1_700_000_000_123_999_999))).first()[0] == "2023-11-14T22:13:20.123Z"


def plain_index(v):
    if v < 256:
        return v, v
    k = min(v.bit_length() - 8, 39)
    sub = v >> k & 255
    return k * 256 + sub, (sub + 1 << k) - 1


def test_histogram(spark):
    rng = random.Random(4)
    values = [0, 1, 255, 256, 257, 511, 512, 2**40, 2**62] + [rng.getrandbits(rng.randint(1, 46)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", formats.histogram_index(F.col("v")).alias("i"))
    got = df.select("v", "i", formats.histogram_edge(F.col("i"))).collect()
    assert [(r[1], r[2]) for r in got] == [plain_index(v) for v in values]


def test_diameter_messages():
    one = s.ccr(310150000000001, [{"rating_group": 10, "input": 60, "output": 40}, {"rating_group": 20, "total": 200, "granted": 5}])
    got = d.segment(one + s.message(b"", command=280) + one[:30])
    assert got["status"] == "truncated" and [m["command_code"] for m in got["messages"]] == [272, 280]
    m = got["messages"][0]
    assert (m["imsi"], m["has_imsi"], m["is_request"], m["cc_request_type"], m["session_id"]) == (310150000000001, True, True, 2, "session;1")
    assert [(x["rating_group"], x["used_total_octets"], x["has_used"], x["has_granted"], x["granted_total_octets"]) for x in m["mscc"]] == [(10, 100, True, False, 0), (20, 200, True, True, 5)]
    eleven = d.message(s.ccr(1, [{"rating_group": i} for i in range(11)]))
    assert len(eleven["mscc"]) == 8 and eleven["mscc_overflow"]
    assert not d.message(s.ccr("12a", []))["has_imsi"] and d.segment(b"") is None and d.segment(b"\1" * 19)["messages"] == []
    big = d.segment(s.ccr(1, [{"rating_group": 1, "total": 2**64 - 1}]))
    assert big["messages"][0]["mscc"][0]["used_total_octets"] == 2**64 - 1


@pytest.mark.parametrize(("data", "status"), [
    (b"\2" + b"\0" * 19, "bad-version"), (b"\1\0\0\x13" + b"\0" * 16, "bad-length"), (b"\1\0\0\x16" + b"\0" * 18, "bad-length"), (b"\1\x20\0\0" + b"\0" * 16, "bad-length"),
    (s.message(b"\0" * 4), "bad-avp"), (s.message(s.avp(1, b"abc")[:8] + b"\0\0\0\0")[:-4] + b"", "truncated"), (s.message((1).to_bytes(4) + b"\x40\0\0\x07"), "bad-avp"), (s.message((1).to_bytes(4) + b"\x80\0\0\x08"), "bad-avp"),
    (s.message((1).to_bytes(4) + b"\x40\0\0\x20"), "bad-avp"),
])
def test_diameter_rejects(data, status):
    assert d.segment(data)["status"] == status


def test_avps_are_bounded_in_depth():
    with pytest.raises(d.Malformed):
        list(d.avps(b"", d.MAX_DEPTH))


def test_random_bytes_never_fail(spark):
    rng = random.Random(9)
    frames = []
    for _ in range(200):
        raw = rng.randbytes(rng.randint(0, 90))
        frames += [raw, s.ethernet(raw), s.ethernet(s.ipv4(s.udp(raw))), s.ethernet(s.ipv4(s.udp(b"\x34\xff" + raw))), s.ethernet(s.ipv4(s.tcp(raw), 6)), s.ethernet(s.ipv6(raw, 0))]
    routed = ingest.frames(packets(spark, frames))
    assert routed.count() == len(frames)
    assert ingest.meter_events(ingest.tunnel_frames(routed)).count() <= len(frames) and ingest.gy_events(ingest.segments(routed)).count() >= 0
