import zlib

import numpy as np
import pyarrow.parquet as pq
from helpers import docs, sample

from meterlake.llm import quality_cnn, toxic_ftrl

SF = "sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def labelled(sf=SF, most=6000):
    known = {r["doc_id"]: r for r in pq.read_table(f"/root/testdata/{sf}/labels.parquet").to_pylist()}
    return [(i, x, known[i]["quality"], known[i]["toxic"]) for i, x, _ in sample(sf=sf) if i in known and len(x) < 12_000][:most]


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 896, 897, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        rows = quality_cnn.chunks(data)
        assert rows.shape[1] == quality_cnn.CHUNK and (bytes(rows[0][:n]) == data[: quality_cnn.CHUNK]) and (n < 512 or bytes(rows[-1]) == data[-512:])
        assert n <= 512 or len(rows) == len(range(0, n - 512, quality_cnn.STEP)) + 1


def test_gradient():
    rng = np.random.default_rng(0)
    net = quality_cnn.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (700, 90, 1500)]
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    g = net.step(texts, y, w)

    def loss():
        p = np.array([net.score(x) for x in texts])
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    for k in ("out", "dense", "filters", "bias", "embed"):
        flat = net.p[k].reshape(-1)
        for i in np.argsort(-np.abs(g[k].reshape(-1)))[:3]:
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 2e-3 * max(1, abs(g[k].reshape(-1)[i])), k


def test_scores_do_not_depend_on_the_company():
    net = quality_cnn.Network(1)
    texts = [x.encode() for _, x, _ in sample(60)] + [b"", b"a" * 200_000]
    assert np.allclose(net.scores(texts), [net.score(x) for x in texts], atol=1e-5)


def test_quality_on_held_out_rows(spark):
    rows = labelled()
    d, k = docs(spark, [r[:2] for r in rows]), labels(spark, [(i, q, t) for i, _, q, t in rows])
    got = {r.doc_id: r for r in quality_cnn.report(d, k).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    test = [(got[i].predicted, q) for i, _, q, _ in rows if got[i].held_out]
    assert np.mean([p == q for p, q in test]) > 0.95 and np.mean([p for p, q in test if q]) > 0.95 and np.mean([not p for p, q in test if not q]) > 0.85
    kept = quality_cnn.keep_good(d, k)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    got = {r.doc_id: r for r in toxic_ftrl.report(docs(spark, [r[:2] for r in rows]), labels(spark, [(i, q, t) for i, _, q, t in rows])).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [(got[i].predicted, t) for i, _, _, t in rows if got[i].held_out]
    assert np.mean([p == t for p, t in test]) > 0.95 and np.mean([p for p, t in test if t]) > 0.75 and np.mean([p for p, t in test if not t]) < 0.03


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(400)]
    y = [int(rng.random() < 0.3) for _ in texts]
    texts = [x + (" Vile!" if t else "") for x, t in zip(texts, y, strict=True)]
    w = toxic_ftrl.Ftrl().fit(texts, y)
    dense = np.zeros(toxic_ftrl.PLACES + 1, np.float32)
    for i, v in w.items():
        dense[i] = v
    f = toxic_ftrl.Features()
    assert 0 < len(w) < 2000 and all((toxic_ftrl.score(f, dense, x) >= 0.5) == bool(t) for x, t in zip(texts, y, strict=True))
    assert toxic_ftrl.score(f, dense, "so vile") > toxic_ftrl.score(f, dense, "so w1")


def test_edges(spark):
    few = labels(spark, [(1, 1, 0), (1, None, None), (None, 0, 1)])
    rows = docs(spark, [(1, None), (2, ""), (2, ""), (None, "x"), (4, "y " * 50_000)])
    from pyspark.sql import functions as F

    clash = rows.withColumns({"score": F.lit("a"), "predicted": F.lit(1)})
    for report, value in ((quality_cnn.report, 1.0), (toxic_ftrl.report, 0.0)):
        got = report(clash, few).collect()
        assert len(got) == 5 and {r.score for r in got} == {value}
        assert report(docs(spark, []), few).count() == 0
    assert quality_cnn.keep_good(clash, few).columns == clash.columns and quality_cnn.keep_good(clash, few).count() == 5
