"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of neighbours and its pairs with one word between, hashed to 2^20 places;
each counts once a text, so a long text does not dilute a word. Training is online, with a rate for each coordinate
and an L1 penalty that keeps most weights at exactly zero. It runs on the driver over at most ``per_class`` labelled
rows of each label of at most ``most_bytes`` bytes (those with the smallest hash of their id: a bounded sample).
What is broadcast are the weights that aren't zero; there can't be more than 2^20.

Scoring is one pass over the texts and shuffles nothing.

Cases: a null text is empty; an empty text has the score of the bias alone; words are split at white space, lower-cased
and stripped of punctuation at their ends; texts of any length are read whole; without labelled rows of both labels
every score is 0; repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 20
EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words whose hashes a worker keeps.
CACHE_WORDS = 500_000
PAIR, SKIP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(44)


class Features:
    """Texts to the places of their features."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        own = (text or "").lower().encode("utf-8", "replace").split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        except KeyError:
            new = {w for w in own if w not in known}
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(own)
        for w in new:
            core = w.strip(EDGE)
            known[w] = zlib.crc32(core) << 20 | zlib.adler32(core) & 0xFFFFF
        return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))

    def places(self, text: str | None) -> np.ndarray:
        """Of all words, neighbours and skip pairs, with repeats."""
        w = self.words(text)
        with np.errstate(over="ignore"):
            x = w * PAIR
            pairs = [w * SKIP]
            if len(w) > 1:
                pairs.append((x[:-1] + w[1:]) * SKIP)
            if len(w) > 2:
                pairs.append((x[:-2] ^ w[2:]) * SKIP + PAIR)
            return (np.concatenate(pairs) >> MIX).astype(np.int64)


class Ftrl:
    """McMahan et al.: w from z and n at each coordinate, zero where |z| is at most l1."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)  # the last place is the bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - y) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g

    def fit(self, texts: list[str], labels: list[int], epochs: int = 5, seed: int = 3) -> dict[int, float]:
        """The weights that aren't zero, by place."""
        features = Features()
        rows = [np.append(np.unique(features.places(x)), PLACES).astype(np.int32) for x in texts]
        y = np.array(labels, float)
        weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.learn(rows[i], y[i], weight[i])
        w = self.weights(np.arange(PLACES + 1))
        return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def score(features: Features, dense: np.ndarray, text: str | None) -> float:
    """dense: the weight of each place and the bias."""
    at = features.places(text)
    hit = at[dense[at] != 0]
    z = dense[np.unique(hit)].sum() + dense[PLACES]
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int) -> list[tuple[str, int]]:
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & ~held_out())
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes).join(sample, "doc_id").collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text, r.toxic))]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_bytes: int = 12_000) -> dict[int, float] | None:
    rows = training_rows(docs, labels, per_class, most_bytes)
    return Ftrl().fit(*map(list, zip(*rows, strict=True))) if len({t for _, t in rows}) == 2 else None


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one an input row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        features, dense = Features(), np.zeros(PLACES + 1, np.float32)
        for i, w in (shared.value or {}).items():
            dense[i] = w
        for batch in batches:
            got = [score(features, dense, x) if shared.value else 0.0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
