import random

from helpers import docs, sample

from meterlake.llm.license_align import TEMPLATES, Scanner, align, rising, scan, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rising():
    rng = random.Random(1)
    for _ in range(100):
        x = rng.sample(range(12), rng.randint(0, 10))
        got = [x[i] for i in rising(x)]
        best = max((sum(1 for _ in s) for s in _subsequences(x)), default=0)
        assert got == sorted(got) and len(got) == best


def _subsequences(x):
    for mask in range(1 << len(x)):
        s = [v for i, v in enumerate(x) if mask >> i & 1]
        if s == sorted(s):
            yield s


def test_alignment_is_common_and_nearly_longest():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 3)) for _ in range(40)]
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(4):
            b.insert(rng.randrange(len(b)), "new")
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) >= 0.9 * lcs(a, b)


def test_templates_within_texts():
    s = Scanner(TEMPLATES, 0.8)
    filler = "the of and to be with for an all rights of this license under permission software ".split()
    rng = random.Random(3)
    for name, text in TEMPLATES.items():
        own = words(text)
        for _ in range(5):
            noise = lambda n: rng.choices(filler, k=n)
            kept = [w for w in own if len(own) < 20 or rng.random() > 0.05]
            at = rng.randint(0, 200)
            found = {n: (c, a, b) for c, n, a, b in s.find(" ".join([*noise(at), "x1", *kept, "x2", *noise(100), *(kept if rng.random() < 0.5 else [])]))}
            assert name in found and found[name][0] >= 0.8, name


def test_table_against_plain_search(spark):
    rows = sample(500)
    got = {r.doc_id: r for r in scan(docs(spark, rows)).collect()}
    for i, text, _ in rows:
        own = " " + " ".join(words(text)) + " "
        verbatim = {n for n, t in TEMPLATES.items() if f" {' '.join(words(t))} " in own}
        found = {x.split(":")[0] for x in got[i].spans.split(",") if x}
        assert verbatim <= found
        assert not found - verbatim or got[i].coverage < 1 or verbatim
        for x in filter(None, got[i].spans.split(",")):
            n, a, b = x.split(":")
            t = words(TEMPLATES[n])
            assert lcs(t, words(text)[int(a) : int(b)]) >= 0.8 * len(t)


def test_every_stretch_is_reported_and_words_may_stand_between():
    s = Scanner(TEMPLATES, 0.8)
    isc, mit = words(TEMPLATES["isc"]), words(TEMPLATES["mit"])
    twice = [*isc, *(f"z{k}" for k in range(300)), *isc, *isc]
    assert sorted(x[2:] for x in s.find(" ".join(twice)) if x[1] == "isc") == [(0, len(isc)), (len(isc) + 300, 2 * len(isc) + 300), (2 * len(isc) + 300, 3 * len(isc) + 300)]
    wide = [y for k, w in enumerate(mit) for y in (w, f"a{k}", f"b{k}", f"c{k}")]
    assert [(x[0], x[2]) for x in s.find(" ".join(["q"] * 50 + wide + ["q"] * 70)) if x[1] == "mit"] == [(1.0, 50)]
    # of two stretches of equal coverage the shorter, then the earlier one comes first
    note = words(TEMPLATES["mit-notice"])
    text = [note[0], "x", *note[1:], *["y"] * 40, *note, *["y"] * 40, *note]
    assert [x[2] for x in s.find(" ".join(text)) if x[1] == "mit-notice"] == [46, 46 + len(note) + 40, 0]


def test_coverage_is_nearly_the_longest_common_one(spark):
    """Against plain longest common subsequences of all stretches, over whole texts into which torn templates are put."""
    rng, rows = random.Random(5), []
    texts = [x for _, x, _ in sample(200) if 200 < len(x) < 1500][:40]
    for k, x in enumerate(texts):
        name, t = rng.choice(list(TEMPLATES.items()))
        torn = [w for w in words(t) if rng.random() > 0.1]
        own = words(x)
        at = rng.randrange(len(own))
        rows.append((k, " ".join([*own[:at], *torn, *own[at:]]), name))
    got = {r.doc_id: {x.split(":")[0] for x in r.spans.split(",") if x} for r in scan(docs(spark, rows)).collect()}
    missed = wrong = 0
    for k, text, _ in rows:
        own = words(text)
        for name, t in TEMPLATES.items():
            t = words(t)
            reach = 5 * len(t)
            share = max((lcs(t, own[i : i + reach]) for i in range(0, len(own), max(1, reach // 4))), default=0) / len(t) if set(t) & set(own) else 0
            missed += share >= 0.9 and name not in got[k]
            wrong += share < 0.6 and name in got[k]
    assert wrong == 0 and missed <= 1


def test_clashing_columns_and_a_very_long_text(spark):
    from pyspark.sql import functions as F

    long_ = "the software is of the and to " * 30_000 + TEMPLATES["mit"] + " the of and" * 1000
    clash = docs(spark, [(1, long_), (2, "All rights reserved.")]).withColumns({c: F.lit(9) for c in ("license", "coverage", "spans", "n_licenses")})
    assert sorted((r.doc_id, r.license) for r in scan(clash).collect()) == [(1, "mit"), (2, "all-rights-reserved")]


def test_edges(spark):
    assert scan(docs(spark, [])).count() == 0
    got = sorted(((r.doc_id, r.n_licenses, r.license) for r in scan(docs(spark, [(1, None), (2, ""), (3, "All rights reserved."), (3, "All rights reserved."), (None, "no"), (5, "All rights")])).collect()), key=str)
    assert got == sorted([(1, 0, None), (2, 0, None), (3, 1, "all-rights-reserved"), (3, 1, "all-rights-reserved"), (None, 0, None), (5, 0, None)], key=str)
    assert scan(docs(spark, [(1, "x")]), {}).first().n_licenses == 0
