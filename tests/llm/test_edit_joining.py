import random

from meterlake.llm import edit_embed
from meterlake.llm.edit_embed import SAMPLES, joining, likeness, near_classes, node_of


def family(rng, n, ranges, changed):
    x = rng.choices("0123456789abcdef", k=ranges * SAMPLES)
    out = []
    for _ in range(n):
        y = list(x)
        for p in rng.sample(range(len(x)), int(changed * len(x))):
            y[p] = rng.choice("0123456789abcdef")
        out.append("".join(y[: len(y) - (cut := rng.choice([0, 0, 9]))]) + "." * cut)
    return out


def parts(n, pairs):
    up = list(range(n))
    for a, b in pairs:
        x, y = up[a], up[b]
        up = [y if r == x else r for r in up]
    return {frozenset(i for i in range(n) if up[i] == r) for r in up}


def test_joins_what_all_like_pairs_join():
    """All pairs by likeness() are the reference, texts of several lengths and classes known before included."""
    rng = random.Random(21)
    prints = [x for ranges in (1, 2, 3, 5) for changed in (0.06, 0.11, 0.14) for x in family(rng, 12, ranges, changed)]
    prints += ["", "." * SAMPLES, "1234567" + "." * 57, "1234568" + "." * 57]
    prints = list(dict.fromkeys(prints))
    rng.shuffle(prints)
    n = len(prints)
    roots = [i - i % 2 if i < 10 else i for i in range(n)]
    like = [(i, j) for i in range(n) for j in range(i) if likeness(prints[i], prints[j]) >= 0.8]
    half = n // 2
    want = parts(n, [*((i, roots[i]) for i in range(n)), *((i, j) for i, j in like if (i < half) != (j < half))])
    got = [(i, half + j) for i, j in joining(roots[:half], prints[:half], roots[half:], prints[half:], 0.8)]
    assert all(likeness(prints[i], prints[j]) >= 0.8 for i, j in got)
    assert parts(n, [*((i, roots[i]) for i in range(n)), *got]) == want
    want = parts(n, [*((i, roots[i]) for i in range(n)), *like])
    got = joining(roots, prints, roots, prints, 0.8)
    assert parts(n, [*((i, roots[i]) for i in range(n)), *got]) == want and len(got) < len(set(roots)) and len(like) > 3 * len(got)


def test_links_of_a_bucket_do_not_grow_with_its_square(spark, monkeypatch):
    """Members unlike the first heads but like one another were paired with each other; classes are those of all pairs."""
    made = []
    real = edit_embed.joined
    monkeypatch.setattr(edit_embed, "HEADS", 0)
    monkeypatch.setattr(edit_embed, "joined", lambda *a: made.append(real(*a).cache()) or made[-1])
    rng = random.Random(22)
    start, prints = "0123456789abcdef" * 2, []
    for _ in range(4):
        prints += [start + x[32:] for x in family(rng, 60, 1, 0.08)]
    prints = list(dict.fromkeys(prints))
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    got = {r.doc_id: r.class_id for r in rows.select("doc_id", node_of()).join(near_classes(rows), "node").collect()}
    like = [(i, j) for i in range(len(prints)) for j in range(i) if likeness(prints[i], prints[j]) >= 0.8]
    want = {i: min(p) for p in parts(len(prints), like) for i in p}
    assert got == want
    assert made[0].count() < 5 * len(prints) < len(like)
