"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned filters
run over the bytes of a chunk and are max-pooled over it; a small layer reads each chunk's pooled filters; its units
are max-pooled and averaged over the chunks and combined into one probability. Repetition shows as few filters
reached, symbols and capitals as filters of their own.

Training happens on the driver, on at most ``per_class`` labelled rows of each label, of at most ``most_bytes`` bytes
each (the rows with the smallest hash of their id: a bounded sample, whatever the table's size). Scoring is one pass
over the texts with the fitted arrays, some 20 kB, and shuffles nothing.

Cases: a null text is empty; an empty text is one chunk of padding and gets a score like any other; texts of any
length are read whole, some thousand chunks at a time; without labelled rows of both labels every score is 1 (nothing
is known against a document); repeated rows score alike; an empty table gives an empty result; other columns are kept
by keep_good() and ignored by scores().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import released, shield, unshield

CHUNK, STEP = 512, 384
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 32, 16
PAD = 0
#: Rows of which a task has the texts as Python strings at a time.
ROWS = 500


def chunks(data: bytes) -> np.ndarray:
    """All of ``data`` as rows of CHUNK bytes, each STEP after the one before; the last ends with the data."""
    n = len(data)
    if n <= CHUNK:
        return np.frombuffer(data + bytes([PAD]) * (CHUNK - n), np.uint8)[None]
    whole = np.frombuffer(data, np.uint8)
    starts = np.append(np.arange(0, n - CHUNK, STEP), n - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[starts]


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "dense": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS + 1, HIDDEN)),
            "dense_bias": np.zeros(HIDDEN),
            "out": rng.normal(0, 1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def windows(self, rows: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(rows, WIDTH, axis=1)[:, ::STRIDE]

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Of each chunk the largest value of each filter (and at which window)."""
        p = self.p
        x = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(p["embed"][rows].reshape(len(rows), -1), WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED])
        z = x.reshape(-1, WIDTH * EMBED) @ p["filters"]
        z = z.reshape(len(rows), -1, FILTERS)
        if where:
            at = z.argmax(axis=1)
            return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + p["bias"], 0), at
        return np.maximum(z.max(axis=1) + p["bias"], 0)

    def units(self, rows: np.ndarray, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = (rows != PAD).mean(axis=1, dtype=np.float32)[:, None]
        x = np.concatenate([pooled, full], axis=1)
        return x, np.maximum(x @ self.p["dense"] + self.p["dense_bias"], 0)

    def score(self, data: bytes, most: int = 256) -> float:
        rows = chunks(data)
        top, total = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float64)
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            _, u = self.units(part, self.pooled(part))
            top, total = np.maximum(top, u.max(axis=0)), total + u.sum(axis=0)
        return self.chance(top, total / len(rows))

    def chance(self, top, mean) -> float:
        z = float(np.concatenate([top, mean]) @ self.p["out"] + self.p["out_bias"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def scores(self, texts: list[bytes], most: int = 256) -> list[float]:
        """score() of each, with the chunks of short texts run together."""
        out: list[float] = []
        held: list[np.ndarray] = []

        def flush():
            if not held:
                return
            part = np.concatenate(held)
            u = np.concatenate([self.units(part[a : a + most], self.pooled(part[a : a + most]))[1] for a in range(0, len(part), most)])
            ends = np.cumsum([len(x) for x in held])
            for a, b in zip(ends - [len(x) for x in held], ends, strict=True):
                out.append(self.chance(u[a:b].max(axis=0), u[a:b].mean(axis=0, dtype=np.float64)))
            held.clear()

        for data in texts:
            if len(data) > most * STEP:
                flush()
                out.append(self.score(data, most))
                continue
            held.append(chunks(data))
            if sum(map(len, held)) >= most:
                flush()
        flush()
        return out

    def step(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean weighted log loss."""
        p = self.p
        each = [chunks(x) for x in texts]
        rows, doc = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
        got = [self.pooled(rows[a : a + 256], True) for a in range(0, len(rows), 256)]
        h, at = (np.concatenate(x) for x in zip(*got, strict=True))
        x, u = self.units(rows, h)
        starts, size = np.searchsorted(doc, np.arange(len(each))), np.bincount(doc).astype(np.float32)
        top = np.maximum.reduceat(u, starts, axis=0)
        both = np.concatenate([top, np.add.reduceat(u, starts, axis=0) / size[:, None]], axis=1)
        chance = 1 / (1 + np.exp(-(both @ p["out"] + p["out_bias"])))
        d = ((chance - y) * weight / len(y)).astype(np.float32)
        g = {"out": both.T @ d, "out_bias": np.array([d.sum()])}
        db = d[:, None] * p["out"]
        du = (db[:, HIDDEN:] / size[:, None])[doc]
        first = (u == top[doc]) & (u > 0)
        du = du + np.where(first, db[:, :HIDDEN][doc], 0)
        du = du * (u > 0)
        g["dense"], g["dense_bias"] = x.T @ du, du.sum(axis=0)
        dh = (du @ p["dense"].T)[:, :FILTERS] * (h > 0)
        g["bias"] = dh.sum(axis=0)
        g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        w = self.windows(rows)
        for f in range(FILTERS):  # only the window that won the pooling has a share
            own = w[np.arange(len(rows)), at[:, f]]
            g["filters"][:, f] = p["embed"][own].reshape(len(rows), -1).T @ dh[:, f]
            np.add.at(g["embed"], own.ravel(), (dh[:, f, None, None] * p["filters"][:, f].reshape(WIDTH, EMBED)).reshape(-1, EMBED))
        return g

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 48, rate: float = 4e-3, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        y = np.array(labels, np.float32)
        weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        m, v, t = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                g = self.step([texts[i] for i in pick], y[pick], weight[pick])
                t += 1
                now = rate * min(1, 2 * (1 - t / (total + 1)))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """At most ``per_class`` rows of each label, in the order of their ids."""
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & ~held_out())
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes).join(sample, "doc_id").collect()
    return [(r.text.encode("utf-8", "replace"), r.quality) for r in sorted(rows, key=lambda r: (r.doc_id, r.text, r.quality))]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, most_bytes: int = 16_000) -> Network | None:
    rows = training_rows(docs, labels, per_class, most_bytes)
    return Network().fit(*map(list, zip(*rows, strict=True))) if len({q for _, q in rows}) == 2 else None


def scored(batches, fitted: dict[str, np.ndarray] | None, keep: tuple[str, ...]):
    """Batches (the columns ``keep`` and) score; texts are Python strings ROWS at a time, and what they took goes back at the end."""
    own = Network()
    if fitted:
        own.p = fitted
    for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
        got = own.scores([(x or "").encode("utf-8", "replace") for x in part.column("text").to_pylist()]) if fitted else [1.0] * len(part)
        yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(got, pa.float64())], names=[*keep, "score"])
        del part, got
    released()


def scores(docs: DataFrame, network: Network | None, *keep: str) -> DataFrame:
    """Rows (the columns ``keep`` and) score."""
    shared = docs.sparkSession.sparkContext.broadcast(network and network.p)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches):
        return scored(batches, shared.value, keep)

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one an input row."""
    scored = scores(docs, fit(docs, labels), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    own = shield(docs, "doc_id", "text")
    scored = scores(own, fit(docs, labels), *own.columns)
    return unshield(scored.where(F.col("score") >= threshold), docs, "doc_id", "text")
