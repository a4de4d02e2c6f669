import random

import numpy as np
import xxhash
from helpers import docs, sample

from meterlake.llm import simhash_trie
from meterlake.llm.simhash_trie import fingerprint, near_duplicates, near_links, one_of_each, trie_links


def plain_fingerprint(text):
    words, w = [], ""
    for c in text:
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\v\f\r":
            words, w = words + [w] * bool(w), ""
        else:
            w += c
    words += [w] * bool(w)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, errors=3):
    """fps: doc_id to fingerprint."""
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= errors):
            x, y = root(i), root(ids[k + 1 + j])
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints():
    for x in ["", " \n", "One", "One two", "a b a b a b a b", "İÉ Ab c d\x1ce f", *(r[1] for r in sample(40))]:
        assert fingerprint(x) % 2**64 == plain_fingerprint(x)


def test_whole_table_against_all_pairs(spark):
    rows = [(r[0], r[1]) for r in sample()]
    got = {r.doc_id: r for r in near_duplicates(docs(spark, rows)).collect()}
    want = {i: plain_fingerprint(x) for i, x in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == plain_components(want)


def test_links_among_clustered_fingerprints(spark):
    """A chain and a dense ball: bits flipped at random from a few centres."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(150):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    x = 0
    for _ in range(30):
        fps.add(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all((r.u ^ r.v).bit_count() <= 3 or ((r.u % 2**64) ^ (r.v % 2**64)).bit_count() <= 3 for r in links)
    want = plain_components(dict(enumerate(fps)))
    at = {f: i for i, f in enumerate(signed)}
    up = dict.fromkeys(range(len(fps)))
    up = {i: i for i in up}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        a, b = root(at[r.u]), root(at[r.v])
        up[max(a, b)] = min(a, b)
    assert {i: root(i) for i in up} == want


def test_large_tries_are_split(spark, monkeypatch):
    """All fingerprints agree in a block of 16 bits, many in two: the same links from tries of a few fingerprints."""
    monkeypatch.setattr(simhash_trie, "HOT", 20)
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(48)
        fps |= {x ^ sum(1 << b for b in rng.sample(range(48), rng.randint(0, 3))) for _ in range(12)}
    fps |= {rng.getrandbits(24) for _ in range(60)}
    fps = sorted(fps)
    links = near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    at = {f: i for i, f in enumerate(fps)}
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        assert (r.u ^ r.v).bit_count() <= 3
        a, b = root(at[r.u]), root(at[r.v])
        up[max(a, b)] = min(a, b)
    assert {i: root(i) for i in range(len(fps))} == plain_components(dict(enumerate(fps)))


def test_clashing_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    long_ = " ".join(f"w{k}" for k in range(200_000))
    clash = docs(spark, [(1, "a b c d"), (2, "a b c d"), (3, long_), (4, long_)]).withColumns({c: F.lit(9) for c in ("fp", "root", "trie", "key", "_may", "_key_id", "component_id")})
    got = one_of_each(clash)
    assert got.columns == clash.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_trie_alone():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 20, 3000).astype(np.uint64))
    links = trie_links(values, np.array([0]), np.array([len(values)]), 2, most=64)
    want = plain_components(dict(enumerate(values.tolist())), 2)
    up = list(range(len(values)))
    for a, b in links:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    assert {i: root(i) for i in range(len(values))} == want


def test_edges(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    rows = [(5, None), (3, ""), (4, " \n"), (None, ""), (7, "a b c d"), (7, "a b c d"), (8, "A b C d"), (None, "q r s t u"), (9, "one")]
    got = near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.fingerprint == "0" * 16 and r.doc_id) == [(3, 3), (4, 3), (5, 3)]
    assert [r.component_id for r in got if r.doc_id in (7, 8)] == [7, 7, 7]


def test_one_stays(spark):
    rows = [(5, None), (3, ""), (7, "a b c d"), (7, "a b c d"), (8, "A b C d"), (None, "A b c d"), (None, "q r s t u v"), (9, "x y z w")]
    got = one_of_each(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "q r s t u v"), (3, ""), (7, "a b c d"), (9, "x y z w")]
