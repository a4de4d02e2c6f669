import duckdb
import pytest

from meterlake.llm import chat_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def rows(spark, found, schema=SCHEMA):
    return spark.createDataFrame(found, schema)


THREAD = [
    (1, 0, "user", "How do I start?\nWhich port is it?"),
    (1, 1, "assistant", "> Which  port is it?\nPort 80."),
    (1, 2, "user", "Something else."),
    (1, 3, "assistant", ">> which port is it?\n> Port 80.\n\nAre you sure?\n"),
    (1, 4, "user", "yes"),
    (1, 5, "user", "> Nobody said this\n>nor this\nok"),
    (2, 0, "user", "Which port is it?"),
    (2, 1, None, " > > Which port is it?"),
    (2, 2, "user", "> Which port is it?\n> port 80."),
]


def test_links_and_order(spark):
    got = {(r.conv_id, r.turn): r for r in chat_quotes.format_chat(rows(spark, THREAD)).collect()}
    assert {k: r.parent for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 3, (1, 5): 4, (2, 0): None, (2, 1): 0, (2, 2): 0}
    assert {k: r.branch for k, r in got.items()} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (1, 4): 3, (1, 5): 3, (2, 0): 0, (2, 1): 0, (2, 2): 2}
    assert (got[1, 3].n_quoted, got[1, 3].n_linked, got[1, 3].max_level) == (2, 2, 2) and (got[1, 5].n_quoted, got[1, 5].n_linked) == (2, 0)
    assert got[1, 1].own_text == "Port 80." and got[1, 3].own_text == "Are you sure?" and got[2, 1].own_text == ""
    assert got[2, 1].chat_text == "<|unknown|>\n\n<|end|>" and got[1, 0].chat_text == "<|user|>\nHow do I start?\nWhich port is it?\n<|end|>"
    for k, r in got.items():  # what is answered stands before, in reply order
        if r.parent is not None:
            up = got[k[0], r.parent]
            assert (up.branch, up.turn) < (r.branch, r.turn)


def same(spark, found):
    df = rows(spark, found)
    c = duckdb.connect()
    c.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = c.sql(chat_quotes.ORACLE)
    columns = sorted(want.columns)
    out = chat_quotes.format_chat(df).select(*columns).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, out)) == sorted(key(r) for r in want.select(*[duckdb.ColumnExpression(x) for x in columns]).fetchall())
    return out


def test_against_sql(spark):
    import random

    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma ray", "delta\tx"]
    made = []
    for conv in range(20):
        for turn in range(rng.randint(1, 9)):
            lines = [rng.choice(("", "", "> ", ">> ", "  >> > ")) + rng.choice(words) for _ in range(rng.randint(1, 4))]
            made.append((conv, turn, rng.choice(("user", "assistant")), "\n".join(lines)))
    same(spark, THREAD + made)


def test_edges(spark):
    got = same(spark, [(None, 0, "user", "a"), (None, None, "user", "b"), (3, 1, None, None), (3, 1, None, None), (3, 2, "user", "> a\n> a"), (3, None, "user", "a"), (4, 5, "user", "")])
    assert len(got) == 7
    assert chat_quotes.format_chat(rows(spark, [])).count() == 0
    from pyspark.sql import functions as F

    assert chat_quotes.format_chat(rows(spark, THREAD).withColumns({c: F.lit(1) for c in ("conv", "parent", "branch", "h", "_chunk")})).count() == len(THREAD)


def test_long_conversations_cross_chunks(spark):
    n = 3 * chat_quotes.CHUNK
    found = [(1, t, "user", f"line {t}" if t != n - 1 else "> line 3\nlate") for t in range(0, n, 7)] + [(1, n, "user", "> line 7\n> line 14\n> line 14\nx")]
    got = {r.turn: r for r in chat_quotes.format_chat(rows(spark, found)).collect()}
    assert got[n].parent == 14 and got[n].branch == n and got[7 * 300].parent == 7 * 299 and got[7 * 400].branch == 0


def test_no_python_in_the_plan(spark):
    plan = chat_quotes.format_chat(rows(spark, THREAD))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("level", [1, 3])
def test_levels(spark, level):
    got = chat_quotes.format_chat(rows(spark, [(1, 0, "user", "A b"), (1, 1, "user", "> " * level + "a  B")])).where("turn = 1").first()
    assert (got.max_level, got.n_linked, got.parent) == (level, 1, 0)


def test_quotes_of_the_table_are_linked(spark):
    """The conversations hold no quotes of their own: with quotes put in, Spark and SQL link the same messages."""
    import duckdb
    import glob
    import os

    from meterlake.llm import queries

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = queries.chat_with_quotes(spark, sf), c.sql(queries.ORACLE_SQL["chat_with_quotes"])
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.select(*columns).fetchall()))
    assert sum(r.n_linked > 0 for r in rows) > 0.3 * len(rows) and any(r.max_level == 2 for r in rows) and any(r.parent != r.turn - 1 for r in rows if r.parent is not None)
