import re

import pyarrow.parquet as pq
from helpers import docs, sample

from meterlake.llm.decontam_template import OPENERS, UNITS, Canon, contaminated, drop_contaminated, matches, report
from meterlake.llm.common import doc_keys

ITEM = "Alice has 12 apples and gives 5 kg of them to Bob before Alice walks 3 miles home."
SAME = "He said: Carol has 90 apples and gives 7 kg of them to Dan before Carol walks 8 miles home. And so on."
TORN = "Carol has 90 apples and gives 7 kg of them to Dan before Erin walks 8 miles home."


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_slots():
    by, value, slot = Canon().windows("It took 5 km, then 5km. Bob saw Bob. THE END", (1,))
    assert slot.tolist() == [False, False, True, True, False, True, True, False, True, False, False]
    assert by[1][2] == by[1][5] and by[1][6] == by[1][8]


def plain_canon(text):
    """(canonical word, value, slot) of each word, with strings alone."""
    edge = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”‘’«»¿¡…–—"
    out, after = [], False
    for line in text.split("\n"):
        opens = True
        for raw in re.split(r"[ \t\r\x0b\x0c]+", line):
            if not raw:
                continue
            core = raw.strip(edge)
            ends = raw.rstrip("\"')”’»")[-1:] in tuple(".!?:…")
            if core and raw.rstrip(".,;:!?)\"'").endswith("%"):
                core += "%"
            if core:
                low, number = core.lower(), re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*", core)
                glued = re.fullmatch(r"[+-]?[$€£]?\d[\d.,]*([^\W\d_]+|%)", core)
                named = core[0].isupper() and core[1:] == core[1:].lower()
                if number:
                    out.append(("<num>", low, True))
                elif glued and glued[1].lower() in UNITS:
                    out.append(("<num>", low, True))
                elif low in UNITS:
                    out.append(("<unit>", low, True) if after else (low, low, False))
                elif named and not (opens and low in OPENERS):
                    out.append(("<name>", low, True))
                else:
                    out.append((low, low, False))
                after = bool(number)
            opens = bool(ends)
    return out


def test_canonical_words():
    for text in [ITEM, SAME, "Tom has 3 kg. Ann: 5km (The end) 7 % 9% of É. Über 4 m…", *(x or "" for _, x, _ in sample(150))]:
        by, value, slot = Canon().windows(text, (1,))
        want = plain_canon(text)
        assert slot.tolist() == [s for *_, s in want]
        for got, column in ((by[1], 0), (value, 1)):
            first = {}
            assert [first.setdefault(h, k) for k, h in enumerate(got.tolist())] == (lambda seen: [seen.setdefault(w[column], k) for k, w in enumerate(want)])({})


def test_names_that_open_sentences_are_placeholders(spark):
    item = "Tom has 3 red apples. Ann has 5 more of them. Bob eats 2 at noon. How many are left for Tom?"
    other = item.replace("Tom", "Wilma").replace("Ann", "Yusuf").replace("Bob", "Zoe").replace("3", "30").replace("5", "51").replace("2", "12")
    loose = "Tom has 3 red apples. They were bought in town by a friend who likes to cook for many people each week."
    got = contaminated(docs(spark, [(1, other), (2, loose)]), items(spark, [item])).collect()
    assert [(r.doc_id, r.item_coverage) for r in got] == [(1, 1.0)]


def test_rows_of_numbers_say_nothing(spark):
    """A table of numbers shares its windows with every item that holds numbers; an item of numbers alone is still found."""
    rows = [(1, " ".join(str(k) for k in range(5000))), (2, "Add 1 2 3 4 5 6 7 8 and say the sum of all these numbers here.")]
    bench = items(spark, ["Add 9 8 7 6 5 4 3 2 and say the sum of all these numbers here.", "1 2 3 4 5 6"])
    got = sorted((r.doc_id, r.item_id) for r in contaminated(docs(spark, rows), bench).collect())
    assert got == [(1, 1), (2, 0), (2, 1)]


def test_clashing_columns_and_a_very_long_text(spark):
    from pyspark.sql import functions as F

    long_ = "plain words without an end " * 100_000 + SAME
    clash = docs(spark, [(1, long_), (2, "clean text of its own")]).withColumns({c: F.lit(9) for c in ("h", "at", "template", "_may", "_key_id", "item_id")})
    got = drop_contaminated(clash, items(spark, [ITEM]))
    assert got.columns == clash.columns and [r.doc_id for r in got.collect()] == [2]


def plain(rows, texts, coverage=0.8):
    """All windows of each document against all items, without a filter."""
    out = set()
    for item, t in enumerate(texts):
        by, v, s = Canon().windows(t or "", (1, 2, 3, 4, 5))
        k = min(5, len(v))
        if not k:
            continue
        for i, x in rows:
            d, dv, _ = Canon().windows(x or "", (k,))
            own = [p for p in range(len(by[k])) if not all(s[p : p + k])] or range(len(by[k]))
            hits = [(p, a) for p in own for a in (d[k] == by[k][p]).nonzero()[0]]
            if len({p for p, _ in hits}) < coverage * len(own):
                continue
            counts = {}
            for p, a in hits:
                for j in range(k):
                    if s[p + j]:
                        c = counts.setdefault(int(a) - p, {}).setdefault(int(v[p + j]), {})
                        c[int(dv[a + j])] = c.get(int(dv[a + j]), 0) + 1
            scored = [(sum(sum(c.values()) for c in m.values()), sum(max(c.values()) for c in m.values())) for m in counts.values()]
            if not scored or (lambda m: m[1] / m[0])(max(scored)) >= coverage:
                out.add((i, item))
    return out


def test_against_all_windows(spark):
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()] + [ITEM]
    rows = [(r[0], r[1]) for r in sample(250)] + [(9001, SAME), (9002, TORN), (9003, ITEM.lower())]
    d = docs(spark, rows)
    keyed = d.select("*", *doc_keys(d))
    got = {(r._key_id, r.item_id) for r in matches(keyed, items(spark, texts)).collect()}
    assert got == plain(rows, texts)
    assert (9001, len(texts) - 1) in got
    verbatim = {i for i, x in rows for t in texts if t in x}
    assert verbatim and verbatim <= {i for i, _ in got}


def test_slot_consistency(spark):
    item = "Alice owes 12 and Alice owns 12 and Alice sold 12 and Alice kept 12 so Alice wins."
    good = "Then Dora owes 7 and Dora owns 7 and Dora sold 7 and Dora kept 7 so Dora wins."
    bad = "Then Dora owes 1 and Emil owns 2 and Fay sold 3 and Gus kept 4 so Hal wins."
    got = {r.doc_id: r.contaminated for r in report(docs(spark, [(1, good), (2, bad)]), items(spark, ["x " + item[:0] + "Then " + item])).collect()}
    assert got == {1: True, 2: False}


def test_edges(spark):
    bench = items(spark, [ITEM, ITEM, None, "", "rare words", "..."])
    rows = [(1, None), (2, ""), (3, SAME), (3, SAME), (None, ITEM), (5, "some rare words here"), (6, "clean text of its own kind"), (7, "")]
    got = report(docs(spark, rows), bench).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or 0) for r in got if r.contaminated) == [0, 3, 3, 5]
    assert all(r.item_id == 0 for r in got if r.doc_id == 3)
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(docs(spark, rows), bench).collect()) == [(0, 0), (3, 0), (3, 0), (5, 4)]
    left = drop_contaminated(docs(spark, rows), bench)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r.doc_id for r in left.collect()) == [1, 2, 6, 7]
    assert drop_contaminated(docs(spark, []), bench).count() == 0
    assert drop_contaminated(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
