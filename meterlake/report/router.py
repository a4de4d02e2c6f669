"""HTTP requests over collected read models, as pure functions; serve() puts them on a socket."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from meterlake.report.prometheus import render

HELP = "usage metering\n\n  /metrics            Prometheus text (?subscribers=N adds the busiest)\n  /stats              counters as JSON\n  /subscribers        busiest subscribers (?limit=N)\n  /subscribers/{imsi} one subscriber\n  /flows              busiest flows (?limit=N)\n  /healthz            liveness\n"


@dataclass
class ReadModel:
    """What the routes answer from. subscribers and flows: None until they have been collected, largest first."""

    stats: str = "{}"
    state: dict = field(default_factory=dict)
    latency: dict = field(default_factory=dict)
    subscribers: list[dict] | None = None
    total_subscribers: int = 0
    flows: list[dict] | None = None
    running: bool = True


def request(line: str) -> tuple[str, str, str] | None:
    """(method, path, query) of a request line, or None."""
    method, space, rest = line.partition(" ")
    if not space or not method:
        return None
    path, _, query = rest.partition(" ")[0].partition("?")
    return (method, path, query) if path.startswith("/") else None


def parameter(query: str, name: str, fallback: int) -> int:
    """The first value of ``name`` if it is all digits."""
    for pair in query.split("&"):
        key, equals, value = pair.partition("=")
        if equals and key == name:
            return int(value) if value.isascii() and value.isdigit() else fallback
    return fallback


def compact(x) -> str:
    return json.dumps(x, separators=(",", ":"))


def route(model: ReadModel, line: str) -> tuple[int, str, str]:
    """(status, content type, body)."""
    text, doc = "text/plain; version=0.0.4", "application/json"
    got = request(line)
    if got is None:
        return 400, text, "bad request\n"
    method, path, query = got
    if method not in ("GET", "HEAD"):
        return 405, text, "method not allowed\n"
    absent = (503, doc, compact({"error": "no snapshot published yet"}) + "\n")
    if path == "/healthz":
        return 200, text, "ok\n" if model.running else "stopped\n"
    if path == "/metrics":
        return 200, text, render(model.state, model.latency, (model.subscribers or [])[: parameter(query, "subscribers", 0)])
    if path == "/stats":
        return 200, doc, model.stats + "\n"
    if path == "/flows":
        if model.flows is None:
            return absent
        rows = model.flows[: parameter(query, "limit", 20)]
        return 200, doc, compact({"flows": rows, "returned": len(rows)}) + "\n"
    if path == "/subscribers":
        if model.subscribers is None:
            return absent
        rows = model.subscribers[: parameter(query, "limit", 50)]
        return 200, doc, compact({"subscribers": rows, "returned": len(rows), "total": model.total_subscribers}) + "\n"
    if path.startswith("/subscribers/"):
        imsi = path.removeprefix("/subscribers/")
        if not (imsi.isascii() and imsi.isdigit()):
            return 400, doc, compact({"error": "imsi must be numeric"}) + "\n"
        if model.subscribers is None:
            return absent
        row = next((r for r in model.subscribers if int(r["imsi"]) == int(imsi)), None)
        return (200, doc, compact(row) + "\n") if row else (404, doc, compact({"error": "no such subscriber in the current snapshot"}) + "\n")
    return 404, text, HELP


def collect(metering, config=None) -> ReadModel:
    """A read model of a Metering plan: at most config.top_subscribers and config.top_flows rows come to the driver."""
    from pyspark.sql import functions as F

    from meterlake.operators import metering as ops, sessions
    from meterlake.report import documents

    config = config or metering.config
    one = metering.state().first()
    installed = sessions.numbered(metering.subscribers)
    rows = documents.subscriber_rows(metering.counters, installed, ops.slots(metering.buckets), metering.gy_totals).orderBy(F.desc("total"), "sub").limit(config.top_subscribers)
    top = documents.flow_rows(metering.flows, installed).orderBy(F.desc("bytes"), "flow_key").limit(config.top_flows)
    spark, state = installed.sparkSession, one.asDict()
    stats = documents.stats_document(spark.createDataFrame([one], metering.state().schema)).first().value
    return ReadModel(stats, state, {k: state[k] for k in documents.SECTIONS["latency_ns"].values()}, [json.loads(r.value) for r in rows.collect()], installed.count(), [json.loads(r.value) for r in top.collect()])


def serve(model: ReadModel, port: int, bind: str = "127.0.0.1"):
    """An HTTP server on the driver; call serve_forever() in a thread of your own, shutdown() to end it."""
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            status, kind, body = route(model, self.requestline)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        do_GET = do_HEAD = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *_):
            pass

    return HTTPServer((bind, port), Handler)
