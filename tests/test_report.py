import json
import threading
import urllib.error
import urllib.request

import pytest

from meterlake.report import documents, prometheus, router

MODEL = router.ReadModel('{"a":1}', {"frames": 5, "ul_bytes": 7, "uptime_s": 1.5}, {"count": 2, "p50_ns": 9, "max_ns": 8}, [{"imsi": "31", "ul_bytes": 3, "dl_bytes": 4}, {"imsi": "32", "ul_bytes": 1, "dl_bytes": 1}], 9, [{"teid": 1}, {"teid": 2}])


def get(path, model=MODEL, method="GET"):
    return router.route(model, f"{method} {path} HTTP/1.1")


def test_exposition():
    text = prometheus.render(MODEL.state, MODEL.latency, MODEL.subscribers[:1])
    lines = text.splitlines()
    assert "meterlake_ingest_frames_total 5" in lines and 'meterlake_meter_direction_bytes_total{direction="uplink"} 7' in lines and "meterlake_uptime_seconds 1.5" in lines
    assert 'meterlake_e2e_latency_ns{quantile="0.5"} 9' in lines and "meterlake_e2e_latency_ns_max 8" in lines and 'meterlake_subscriber_bytes_total{imsi="31",direction="downlink"} 4' in lines
    types = [x.split()[2] for x in lines if x.startswith("# TYPE")]
    assert len(types) == len(set(types)) and {x.split("{")[0].split()[0].removesuffix("_max").removesuffix("_count") for x in lines if x[0] != "#"} == set(types)
    assert "subscriber_bytes" not in prometheus.render({})


def test_routes():
    assert get("/healthz")[2] == "ok\n" and get("/stats")[2] == '{"a":1}\n' and get("/nope")[0] == 404 and get("/stats", method="POST")[0] == 405 and router.route(MODEL, "garbage")[0] == 400 and get("stats")[0] == 400
    assert json.loads(get("/subscribers?limit=1")[2]) == {"subscribers": MODEL.subscribers[:1], "returned": 1, "total": 9}
    assert json.loads(get("/subscribers/32")[2])["ul_bytes"] == 1 and get("/subscribers/33")[0] == 404 and get("/subscribers/notanimsi")[0] == 400 and get("/subscribers/")[0] == 400
    assert json.loads(get("/flows?limit=1")[2]) == {"flows": [{"teid": 1}], "returned": 1}
    assert "subscriber_bytes_total" in get("/metrics?subscribers=1")[2] and "subscriber_bytes_total" not in get("/metrics")[2]
    empty = router.ReadModel()
    assert get("/subscribers", empty)[0] == get("/flows", empty)[0] == get("/subscribers/1", empty)[0] == 503 and get("/subscribers/x", empty)[0] == 400


@pytest.mark.parametrize(("query", "value"), [("a=1&limit=25&b=2", 25), ("limit=abc", 50), ("limit=", 50), ("", 50), ("limit=1&limit=2", 1), ("limit", 50)])
def test_parameters(query, value):
    assert router.parameter(query, "limit", 50) == value


def test_server():
    server = router.serve(MODEL, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert urllib.request.urlopen(f"{base}/healthz").read() == b"ok\n"
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{base}/nope")
    finally:
        server.shutdown()
        server.server_close()


def test_summary():
    text = documents.summary({"frames": 10, "gtpu_gpdus": 4, "bytes": 3, "ul_bytes": 1, "dl_bytes": 2}, 2.0, {"count": 1, "p50_ns": 1, "p99_ns": 2, "p999_ns": 3, "p9999_ns": 4, "max_ns": 5})
    assert "  GTP-U G-PDUs         4\n" in text and "3 (ul 1 / dl 2)" in text and "p99.9=3" in text


def test_read_model_of_a_plan(spark):
    from meterlake.plans import queries

    model = router.collect(queries.plan(spark, "/root/testdata/sf0.001"))
    assert model.total_subscribers == len(model.subscribers) == 15 and len(model.flows) == 64 and json.loads(model.stats)["meter"]["events"] == 1000
    row = json.loads(router.route(model, f"GET /subscribers/{model.subscribers[0]['imsi']} HTTP/1.1")[2])
    assert list(row) == ["imsi", "sub", "ul_teid", "dl_teid", "ul_bytes", "dl_bytes", "ul_packets", "dl_packets", "gy_reported_octets", "gy_reports", "buckets", "bucket_aggregated"]
    assert sum(b["bytes"] for b in row["buckets"]) == row["ul_bytes"] + row["dl_bytes"]
