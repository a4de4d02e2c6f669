import hashlib
import random

from helpers import docs, sample

from meterlake.llm import edit_embed as e


def plain_walk(text):
    """What the walk writes, a step at a time."""
    own, out, i = e.classes(text), [], 0
    while i < len(own):
        stay = e.STEPS[(len(out) % e.PERIOD) << 8 | int(own[i])]
        out += [own[i]] * stay
        i += 1
    return out


def test_fingerprints_sample_the_walk():
    for _, x, _ in sample(20):
        x = x[:3000]
        out = plain_walk(x)
        level, want = 0, ""
        while level == 0 or e.FIRST << (level - 1) < len(out):
            want += "".join("%x" % (out[p] & 15) if p < len(out) else "." for p in e.places(level))
            level += 1
        assert e.fingerprint(x) == want
    assert e.fingerprint("") == e.fingerprint(None) == ""


def test_staying_is_waiting_for_the_shared_bit():
    """The steps of consecutive places belong to one walk: staying k > 1 at j is staying k - 1 at j + 1."""
    for c in range(0, 256, 17):
        for j in range(e.PERIOD - 1):
            k = e.STEPS[j << 8 | c]
            assert k >= 1 and (k == 1 or e.STEPS[(j + 1) << 8 | c] == k - 1)


def test_small_edits_are_near_and_others_far():
    rng, near, far = random.Random(5), [], []
    texts = [x for _, x, _ in sample(150) if len(x) > 400]
    for x, other in zip(texts, texts[1:]):
        p = rng.randrange(len(x) // 2)
        near.append(e.likeness(e.fingerprint(x), e.fingerprint(x[:p] + "qz" + x[p:])))
        far.append(e.likeness(e.fingerprint(x), e.fingerprint(other)))
    assert sorted(near)[len(near) // 10] > 0.6 and sum(x > 0.8 for x in near) > 0.8 * len(near) and max(far) < 0.4
    assert e.likeness("", "") == 1 and e.likeness("", e.fingerprint("abc")) == 0


def check(spark, rows):
    got = e.edited_and_next(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: r[0])
    texts = [x or "" for _, x in order]
    want = {}
    for k, (i, _) in enumerate(order):
        x, following = texts[k], texts[(k + 1) % len(texts)]
        edited = x[: len(x) - len(x) // 4] + following[: len(x) // 4]
        mine, other = e.fingerprint(x), e.fingerprint(edited)
        want[i] = (len(x), hashlib.sha256(edited.encode()).hexdigest(), mine, other, e.likeness(mine, other), e.likeness(mine, e.fingerprint(following)))
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want
    return got


def test_edited_and_next(spark):
    rows = [(3 * r[0] % 997, r[1][:4000]) for r in sample(300)] + [(2000, None), (2001, ""), (2002, "é"), (2003, "abcd\U0001f600"), (2004, "x" * 30_000)]
    got = check(spark, rows)
    long_ = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next + 0.2 for r in long_) > 0.99 * len(long_)


def test_edges(spark):
    assert e.edited_and_next(docs(spark, [])).count() == 0
    check(spark, [(5, "alone here")])
    check(spark, [(5, None), (1, "ab cd")])
    from pyspark.sql import functions as F

    rows = docs(spark, [(1, "a b c d"), (1, "a b c d"), (None, "n"), (2, "z")]).withColumns({"part": F.lit(1), "role": F.lit(2), "fingerprint": F.lit("f")})
    assert e.edited_and_next(rows).count() == 4


def test_near_duplicates(spark):
    rng, rows = random.Random(6), []
    base = [x for _, x, _ in sample(120) if 600 < len(x) < 4000][:30]
    for k, x in enumerate(base):
        rows.append((k, x))
        p = len(x) - rng.randint(5, 30)
        rows += [(100 + k, x[:p] + "Q" + x[p:]), (200 + k, x)]
    got = {r.doc_id: r.class_id for r in e.near_duplicates(e.fingerprints(docs(spark, rows))).collect()}
    own = lambda i: {j for j, c in got.items() if c == got[i]}
    assert all(got[200 + k] == got[k] for k in range(len(base))) and sum(got[100 + k] == got[k] for k in range(len(base))) >= 0.9 * len(base)
    exact = {x: k for k, x in enumerate(base)}
    assert all(len(own(k)) <= 3 for k in range(len(base)) if list(exact.values()).count(k) == 1)
