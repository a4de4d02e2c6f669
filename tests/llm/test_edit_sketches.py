import random

from meterlake.llm.edit_embed import SAMPLES, likeness, may_be_like, sketches


def test_sketches_of_three_ranges_tell_exactly(spark):
    """Pairs just below the bound went on to be compared; with all samples known none does, and none above is lost."""
    rng, prints = random.Random(17), []
    for ranges in (1, 2, 3):
        for _ in range(20):
            x = rng.choices("123456789abcdef", k=ranges * SAMPLES)
            y = list(x)
            for p in rng.sample(range(len(x)), int(rng.uniform(0.1, 0.3) * len(x))):
                y[p] = rng.choice("123456789abcdef".replace(x[p], ""))
            prints += ["".join(x), "".join(y), "".join(y[:-9]) + "." * 9]
    df = sketches(spark.createDataFrame(list(enumerate(prints)), "node long, fingerprint string")).cache()
    a, b = (df.select(*(df[c].alias(f"{s}_{c}") for c in df.columns)) for s in "ab")
    got = {(r[0], r[1]): r[2] for r in a.crossJoin(b).where("a_node < b_node").selectExpr("a_node", "b_node", f"{may_be_like(0.8)}").collect()}
    same = {p: likeness(prints[p[0]], prints[p[1]]) for p in got}
    assert sum(0.75 <= x < 0.8 for x in same.values()) > 5 and sum(x >= 0.8 for x in same.values()) > 20
    assert all(may == (same[p] >= 0.8) for p, may in got.items())
