import random

import pytest

from meterlake.llm import common
from meterlake.llm.common import components


@pytest.mark.parametrize("few", [0, 10**6])
def test_few_links_settle_as_many_do(spark, few):
    """Chains, a hub, loops, negative nodes and both directions; on the driver and in rounds."""
    rng = random.Random(16)
    links = [(i, i + 1) for i in range(-40, 0)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (2**62, -(2**63))]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    links += [(b, a) for a, b in links[::3]]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [] if x in want else [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    df = spark.createDataFrame(links, "u long, v long")
    got = components(df, few=few).collect()
    assert len(got) == len(want) and {r.u: r.root for r in got} == want
    assert components(df.limit(0), few=few).count() == 0


def test_few_links_take_no_rounds(spark, monkeypatch):
    written = []
    real = common.cut
    monkeypatch.setattr(common, "cut", lambda df, *a: written.append(a) or real(df, *a))
    components(spark.range(300).selectExpr("id as u", "id + 1 as v"), few=common.FEW_LINKS)
    assert len(written) <= 2
