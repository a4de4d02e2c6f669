import hashlib
import random
import re
import time

from helpers import docs, sample

from meterlake.llm.secret_scan import KINDS, bare_spans, base_spans, live_looking, scan

KEYED = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    a = [(m.start(), 0, m.end()) for m in KEYED.finditer(text) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return a, b, c


def digest(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_base_findings(spark):
    odd = ["tokEn = 'abc' token=\"abcdef\"", "ſecret=abcdefg toKen=abcdefg", "é password:abc123 AKIA" + "A" * 16 + " AKIAAKIA", "api_key=api-key: token=zzzzzz", "0" * 24 + "g" + "f" * 23, None, ""]
    rows = sample(400) + [(9000 + i, x, "s") for i, x in enumerate(odd)]
    got = {r.doc_id: r for r in scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, x, _ in rows:
        a, b, c = plain(x or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (len(a), len(b), len(c)), x
        assert r.base_sha256 == hashlib.sha256(digest(a + b + c).encode()).hexdigest()
        assert set(filter(None, digest(a + b + c).split(","))) <= set(r.spans.split(","))


def test_ownership(spark):
    strong = "Zk9" + "qW3rT5yU7iO1pA2sD4"
    rows = [(i, "token=example123", f"org{i}/r") for i in range(4)] + [(10, "password=hunter42x9b7", "org1/a"), (11, "see hunter42x9b7 here", "org1/b")] + [(12, f"bare {strong} x", "org5/r"), (13, "ref aB3" + "dE6gH9jK2mN5pQ8s", "o1/r")] + [(14 + i, "ref aB3" + "dE6gH9jK2mN5pQ8s", f"o{i + 2}/r") for i in range(3)]
    got = {r.doc_id: r for r in scan(docs(spark, rows)).collect()}
    assert all(got[i].n_example == 1 and got[i].n_live == 0 for i in range(4))
    assert got[10].n_live == 1 and got[11].spans == "bare:4:16"  # the value of a base finding, without its keyword
    assert got[12].spans.startswith("bare:5:") and all(got[i].spans == "" for i in (13, 14, 15, 16))  # held by four owners: an example


def test_nulls_repeats_and_empty(spark):
    assert scan(docs(spark, [])).count() == 0
    got = scan(docs(spark, [(None, "token=abcdefg", None), (1, "token=abcdefg", None), (1, "token=abcdefg", None)])).collect()
    assert len(got) == 3 and all(r.n_assign == 1 and r.n_live == 0 and r.n_repeated == 1 for r in got)


def test_ownership_against_plain_counts(spark):
    """Every value's owners counted over the whole table without hashes; the judgement follows from them."""
    rng = random.Random(2)
    values = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randint(8, 26))) for _ in range(40)]
    rows = []
    for i in range(400):
        v = rng.choice(values) if rng.random() < 0.7 else rng.choice(values[:4])
        text = rng.choice(["token={}", "see {} there", "password: {} and secret={}", "x{}"]).replace("{}", v)
        rows.append((i, text, rng.choice([None, f"o{rng.randrange(9)}/r{rng.randrange(3)}", f"solo{rng.randrange(4)}"])))
    held, based, places = {}, set(), {}
    each = {}
    for i, x, source in rows:
        base = base_spans(x)
        each[i] = [(a, k, b, v, True) for a, k, b, v in base] + [(a, k, b, v, s) for a, k, b, v, s in bare_spans(x, base)]
        for a, k, b, v, s in each[i]:
            held.setdefault(v, set()).add((source or "").split("/")[0])
            places[v] = places.get(v, 0) + 1
            based |= {v} if k < 3 else set()
    got = {r.doc_id: r for r in scan(docs(spark, rows)).collect()}
    for i, found in each.items():
        kept = sorted((a, k, b, v) for a, k, b, v, s in found if k < 3 or v in based or s and len(held[v]) < 3)
        r = got[i]
        assert r.spans == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in kept)
        want = (sum(len(held[v]) < 3 and live_looking(v) for *_, v in kept), sum(len(held[v]) >= 3 for *_, v in kept), sum(places[v] > 1 for *_, v in kept))
        assert (r.n_live, r.n_example, r.n_repeated) == want


def test_overlaps_are_found_in_one_pass():
    def run(n):
        text = "".join(f"token=a1b2c3d4e5f{i} x9y8z7w6v5u4t{i} " for i in range(n))
        began = time.perf_counter()
        assert len(bare_spans(text, base_spans(text))) == n
        return time.perf_counter() - began

    run(1000)
    assert run(20_000) < 60 * max(run(1000), 1e-3)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    clash = docs(spark, [(1, "token=abcdefg"), (2, "x" * 3_000_000 + " token=abcdefg")]).withColumns({c: F.lit(9) for c in ("row", "repo", "found", "hash", "spans", "owners")})
    assert sorted((r.doc_id, r.n_assign) for r in scan(clash).collect()) == [(1, 1), (2, 1)]
