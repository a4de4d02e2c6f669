import numpy as np
from helpers import docs, sample

from meterlake.llm import common
from meterlake.llm.edit_embed import SAMPLES, fingerprint, likeness, near_duplicates, report


def test_members_unlike_the_head_and_short_texts_meet(spark):
    head, x, y = "a" * 8 + "0" * 56, "a" * 8 + "1" * 56, "a" * 8 + "1" * 50 + "2" * 6
    p, q, r = "bcdefa1".ljust(64, "."), "bcdefa2".ljust(64, "."), "1357".ljust(64, ".")
    assert likeness(x, y) >= 0.8 > max(likeness(head, x), likeness(head, y)) and likeness(p, q) >= 0.8
    got = near_duplicates(spark.createDataFrame(list(enumerate([head, x, y, p, q, r])), "doc_id long, fingerprint string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_nine_in_ten_of_all_like_pairs_share_a_class(spark, monkeypatch):
    """All pairs of the table's fingerprints are the reference; buckets are dealt in small chunks."""
    monkeypatch.setattr(common, "CHUNK_FEW", 3)
    monkeypatch.setattr(common, "CHUNK_ALL", 5)
    rows = [(i, x[:6000] if x else x) for i, x, _ in sample()]
    got = {r.doc_id: r.class_id for r in report(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    prints = {i: fingerprint(x) for i, x in rows}
    ids = sorted(prints)
    most = max(map(len, prints.values()))
    grid = np.frombuffer("".join(prints[i].ljust(most, ".") for i in ids).encode(), np.uint8).reshape(len(ids), most)
    level = np.arange(most) // SAMPLES
    weight = np.where(level == 0, 1.0, np.exp2(np.maximum(level - 1, 0)))
    near = []
    for k in range(len(ids)):
        there = (grid[k + 1 :] != ord(".")) | (grid[k] != ord("."))
        alike = (weight * ((grid[k + 1 :] == grid[k]) & there)).sum(axis=1) / np.maximum(1e-9, (weight * there).sum(axis=1))
        near += [(ids[k], ids[k + 1 + j]) for j in np.flatnonzero(alike >= 0.8)]
    near += [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if prints[a] == prints[b] == ""]
    assert len(near) > 30 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    linked = {x for p in near for x in p}
    assert all(c == i for i, c in got.items() if i not in linked)
    a, b = near[0]
    assert likeness(prints[a], prints[b]) >= 0.8


def test_rows_without_doc_id(spark):
    got = report(docs(spark, [(None, "one text here of some length"), (None, "one text here of some length"), (4, "another one, quite different"), (4, "one text here of some length")])).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == [(0, 4), (0, 4), (4, 4), (4, 4)]


def test_sketches_let_all_like_pairs_through(spark):
    """The native bound against likeness() on all pairs of real and edited texts, tops apart included."""
    from meterlake.llm.edit_embed import may_be_like, node_of, sketches

    texts = [x for _, x, _ in sample(120) if 30 < len(x) < 3000][:60]
    texts += [x[: len(x) - len(x) // k] for x in texts[:30] for k in (3, 8)] + [x[:9] + "!" + x[9:] for x in texts[:30]]
    rows = spark.createDataFrame([(fingerprint(x),) for x in texts], "fingerprint string").select("fingerprint", node_of()).distinct()
    own = sketches(rows).join(rows, "node")
    a, b = (own.select(*(own[c].alias(f"{s}_{c}") for c in own.columns)) for s in "ab")
    pairs = a.crossJoin(b).where("a_node < b_node").selectExpr("a_fingerprint", "b_fingerprint", f"{may_be_like(0.8)} as may").collect()
    like = [(likeness(r[0], r[1]) >= 0.8, r.may) for r in pairs]
    assert sum(x for x, _ in like) > 50 and all(may for x, may in like if x) and sum(may for x, may in like if not x) < 0.05 * len(like)
