"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text's characters: at step j the character at the walk's place is written, and the walk
moves on if the shared bit for (j, character) says so. Texts at a small edit distance walk apart at an edit and fall
into step again soon after, so that edit distance becomes Hamming distance between what is written. The fingerprint
samples that string at shared places: 64 in each of the ranges [0, 64), [64, 128), [128, 256) and so on, a hexadecimal
digit (four bits of the character's hash) for each; places behind the walk's end are ".". likeness() weighs each place
by the length of the range it stands for, which estimates the share of places at which the embeddings agree.

near_duplicates() samples bands of eight places within each of a fingerprint's three last ranges, which stand for
seven eighths of the text. Documents that agree in a band share a bucket; each is held against the bucket's smallest
node and then, in chunks, against those still in another class, and what is like enough is linked. Texts too short
for a band meet by pieces of their few samples. op8's query gives each document's class as well.

edited_and_next() compares each text with an edited one and with the next document's. Rows are dealt by ranges of
doc_id (and of the texts' hashes, so that one id may go to several tasks), so each task finds the next text within its own rows; only the first and the last row of each task are
joined across tasks.

Cases: a null text is empty; the fingerprint of an empty text is empty, like another empty one (1) and unlike all else
(0); texts are read whole, in memory that a text itself needs; rows of equal doc_id follow one another by the hash of
their text; a null doc_id comes first; a table of one row is its own next; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.common import FEW_LINKS, components, cut, dealt_apart, masked, swept

SAMPLES, FIRST, PERIOD, CLASSES = 64, 64, 1024, 256
BAND = 8
#: Further members of a bucket that the others are held against before what is still apart meets in pairs.
HEADS = 3


def _steps() -> bytes:
    """At (step modulo PERIOD, class of a character): how many steps the walk stays at the character."""
    move = np.random.default_rng(20).random((PERIOD, CLASSES)) < 0.5
    move[0] = True  # so that every walk moves on
    stay = np.zeros((2 * PERIOD, CLASSES), np.int64)
    for j in range(2 * PERIOD - 2, -1, -1):
        stay[j] = np.where(move[j % PERIOD], 1, stay[j + 1] + 1)
    return np.minimum(stay[:PERIOD], 255).astype(np.uint8).tobytes()


STEPS = _steps()
_places: list[np.ndarray] = []


def places(level: int) -> np.ndarray:
    """The sampled places of a range, ascending."""
    while len(_places) <= level:
        n = len(_places)
        low, size = (0, FIRST) if n == 0 else (FIRST << (n - 1), FIRST << (n - 1))
        _places.append(np.sort(low + np.random.default_rng(100 + n).integers(0, size, SAMPLES)))
    return _places[level]


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((points * np.uint64(0x9E3779B97F4A7C15 & (2**56 - 1))) >> np.uint64(24)).astype(np.uint8)


def walk(own: bytes, j: int = 0) -> tuple[np.ndarray, int]:
    """The step at which each character is reached, from step j on, and the step behind the last."""
    at, steps = [], STEPS
    put = at.append
    for c in own:
        put(j)
        j += steps[(j & 1023) << 8 | c]
    return np.array(at, np.int64), j


def sampled(own: np.ndarray, at: np.ndarray, end: int) -> str:
    """The fingerprint of a text's classes, reached at the steps ``at``."""
    if not len(own):
        return ""
    level, where = 0, []
    while level == 0 or FIRST << (level - 1) < end:
        where.append(places(level))
        level += 1
    p = np.concatenate(where)
    digits = own[np.searchsorted(at, p, side="right") - 1] & 15
    return np.where(p < end, np.frombuffer(b"0123456789abcdef", np.uint8)[digits], ord(".")).astype(np.uint8).tobytes().decode()


def fingerprint(text: str | None) -> str:
    own = classes(text or "")
    return sampled(own, *walk(own.tobytes()))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, ".").encode(), np.uint8) for s in (a, b))
    level = np.arange(n) // SAMPLES
    weight = np.where(level == 0, 1.0, np.exp2(np.maximum(level - 1, 0)))
    there = (x != ord(".")) | (y != ord("."))
    return float((weight * ((x == y) & there)).sum() / (weight * there).sum())


def compared(text: str, following: str, known: tuple | None = None) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited) of a text and the next one's start."""
    n = len(text)
    own, at, end = known or walked(text)
    kept = n - n // 4
    edited = text[:kept] + following[: n // 4]
    new = np.concatenate([own[:kept], classes(following[: n // 4])])
    more, edited_end = walk(new[kept:].tobytes(), int(at[kept]) if kept < n else end)
    mine, other = sampled(own, at, end), sampled(new, np.concatenate([at[:kept], more]), edited_end)
    return n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine, other, likeness(mine, other)


def walked(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    own = classes(text)
    return own, *walk(own.tobytes())


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one an input row."""
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ddl = f"part int, role int, text string, doc_id long, {COLUMNS}"  # role 0: a result, 1: a task's first row, 2: its last
    names = [f.name for f in T.StructType.fromDDL(ddl)]
    schema = pa.schema([("part", pa.int32()), ("role", pa.int32()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((k, pa.string()) for k in names[5:8]), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                now = (doc, text, walked(text))
                mine = sampled(*now[2])
                if last is None:
                    out.append((part, 1, text, doc, None, None, mine, None, None, None))
                else:
                    found = compared(last[1], text, last[2])
                    out.append((part, 0, None, last[0], *found, likeness(found[2], mine)))
                last = now
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, 2, last[1], last[0], None, None, sampled(*last[2]), None, None, None), schema, strict=True)], schema=schema)

    spark = docs.sparkSession
    rows = cut(dealt.mapInArrow(run, ddl), "edit-embedding", "gzip")
    parts = sorted(r.part for r in rows.where("role = 1").select("part").collect())  # one a task
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, head int")
    heads = rows.where("role = 1").select(F.col("part").alias("head"), F.col("text").alias("following"), F.col("fingerprint").alias("next_fingerprint"))
    ends = rows.where("role = 2").select("part", "doc_id", "text").join(following, "part").join(heads, "head").select("doc_id", "text", "following", "next_fingerprint")

    def close(batches):
        for batch in batches:
            out = []
            for doc, text, after, other in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "following", "next_fingerprint")), strict=True):
                found = compared(text, after)
                out.append((doc, *found, likeness(found[2], other)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[3:], strict=True)], names=names[3:])

    return rows.where("role = 0").select(*names[3:]).unionByName(ends.mapInArrow(close, f"doc_id long, {COLUMNS}"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(x) for x in batch.column("text").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _bands() -> list[list[int]]:
    """The places within a range's samples of each of its bands, dealt at random."""
    order = np.random.default_rng(55).permutation(SAMPLES)
    return [sorted(order[i : i + BAND].tolist()) for i in range(0, SAMPLES, BAND)]


def levels_of(nodes: DataFrame) -> DataFrame:
    """Of rows (node, fingerprint): rows (node, level, own), the samples of its three last ranges."""
    last = F.length("fingerprint") / SAMPLES
    levels = F.sequence(F.greatest(last - 3, F.lit(0)).cast("int"), F.greatest(last - 1, F.lit(0)).cast("int"))
    each = nodes.select("node", "fingerprint", F.explode(levels).alias("level"))
    return each.select("node", "level", F.substring("fingerprint", F.col("level") * SAMPLES + 1, F.lit(SAMPLES)).alias("own"))


def bands_of(nodes: DataFrame) -> DataFrame:
    """Of rows (node, fingerprint): rows (key, node), one a band; bands that reach behind the text's end are left out."""
    # of the first range neighbours go together, so that short texts fill a band
    spread = lambda band: F.concat(*(F.substring("own", p + 1, 1) for p in band))
    first = F.array(*(F.substring("own", i + 1, BAND) for i in range(0, SAMPLES, BAND)))
    texts = F.when(F.col("level") == 0, first).otherwise(F.array(*map(spread, _bands())))
    each = levels_of(nodes).select("node", "level", F.posexplode(texts).alias("band", "own")).where(f"length(own) = {BAND} and not contains(own, '.')")
    return each.select(F.xxhash64("level", "band", "own").alias("key"), "node")


def sketches(nodes: DataFrame) -> DataFrame:
    """Rows (node, top, c, s00 to s23): the last range, its samples before the text's end, and of the three last ranges
    (the last first) the samples, sixteen a number, four bits each."""
    last = F.greatest(F.ceil(F.length("fingerprint") / SAMPLES) - 1, F.lit(0)).cast("int")
    df = nodes.select("node", last.alias("top"), "fingerprint")
    own = lambda d: F.when(F.col("top") >= d, F.substring("fingerprint", (F.col("top") - d) * SAMPLES + 1, F.lit(SAMPLES)))
    part = lambda d, i: F.conv(F.substring(F.translate(own(d), ".", "0"), 16 * i + 1, 16), 16, -10).cast("long").alias(f"s{d}{i}")
    return df.select("node", "top", F.length(F.regexp_replace(own(0), "[.]", "")).alias("c"), *(part(d, i) for d in range(3) for i in range(4)))


def may_be_like(least: float) -> str:
    """SQL over two rows of sketches() (a_, b_): false only where likeness() is below ``least``.

    The weight of samples that differ in the ranges known of both, against the weight of all; ranges below count as equal.
    """

    def differ(x, y):  # samples of two ranges that differ: four bits each, set to one
        each = (f"(a_s{x}{i} ^ b_s{y}{i})" for i in range(4))
        return " + ".join(f"coalesce(bit_count(({e} | shiftrightunsigned({e}, 1) | shiftrightunsigned({e}, 2) | shiftrightunsigned({e}, 3)) & {0x1111111111111111}L), 0)" for e in each)

    weight = lambda level: f"(case when {level} <= 0 then 1 else power(2, {level} - 1) end)"
    total = lambda c, top: f"({weight(top)} * {c} + case when {top} = 0 then 0 else {SAMPLES} * power(2, {top} - 1) end)"
    same = " + ".join(f"{weight(f'(a_top - {d})')} * ({differ(d, d)})" for d in range(3))
    allowed = 1 - least + 1e-9
    cases = [f"when a_top = b_top then {same} <= {allowed!r} * {total('greatest(a_c, b_c)', 'a_top')}"]
    for hi, lo in (("a", "b"), ("b", "a")):
        pairs = [differ(*((d + 1, d) if hi == "a" else (d, d + 1))) for d in range(2)]
        lost = f"{weight(f'{hi}_top')} * {hi}_c + " + " + ".join(f"{weight(f'({lo}_top - {d})')} * ({x})" for d, x in enumerate(pairs))
        cases.append(f"when {hi}_top = {lo}_top + 1 then {lost} <= {allowed!r} * {total(f'{hi}_c', f'{hi}_top')}")
    return f"(case {' '.join(cases)} else false end)"


def joining(roots_a: list, prints_a: list[str], roots_b: list, prints_b: list[str], least: float) -> list[tuple[int, int]]:
    """Places (in a, in b) of pairs with a likeness() of ``least`` or more, so many as join all classes that such pairs join.

    What is already joined, by its class or by pairs before, isn't paired again: there are fewer pairs than classes.
    """
    size = max(map(len, [*prints_a, *prints_b, "."]))
    grid = lambda prints: np.frombuffer("".join(x.ljust(size, ".") for x in prints).encode(), np.uint8).reshape(len(prints), size)
    a, b = grid(prints_a), grid(prints_b)
    level = np.arange(size) // SAMPLES
    weight = np.where(level == 0, 1.0, np.exp2(np.maximum(level - 1, 0)))
    total = lambda x: ((x != ord(".")) * weight).sum(axis=1)  # noqa: E731  places behind the end come last: of two texts the longer has all that either has
    all_a, all_b = total(a), total(b)
    _, own = np.unique(np.array([*roots_a, *roots_b], np.int64), return_inverse=True)
    own_a, own_b, found = own[: len(a)], own[len(a) :].copy(), []
    up = np.arange(own.max() + 1)  # class -> the class that it has come to
    for i in range(len(a)):
        mine = up[own_a[i]]
        rest = np.flatnonzero(up[own_b] != mine)
        low = max(0, (len(prints_a[i]) // SAMPLES - 2) * SAMPLES)
        whole = np.maximum(all_b[rest], all_a[i])
        for lo, hi, kind in ((low, low + 2 * SAMPLES, np.float32), (0, size, np.float64)):  # two ranges, most of the weight, rule out most; of them 24 bits are exact
            with np.errstate(invalid="ignore"):  # texts too short for any sample are like none
                keep = (whole - (b[rest, lo:hi] != a[i, lo:hi]).astype(kind) @ weight[lo:hi].astype(kind)) / whole >= least
            rest, whole = rest[keep], whole[keep]
        for j in rest[np.unique(up[own_b[rest]], return_index=True)[1]]:
            found.append((i, int(j)))
            up[up == up[own_b[j]]] = mine
    return found


def joined(held: DataFrame, roots: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of rows (key, node): links (u, v) that join what shares a bucket and is like, as far as ``roots`` doesn't yet.

    All that meets is compared, but a chunk of a bucket gives no more links than it has classes, however many are like.
    """

    def run(batches):
        key, of_a, of_b = None, ([], [], []), ([], [], [])

        def links():
            found = joining(of_a[1], of_a[2], of_b[1], of_b[2], least) if of_a[0] and of_b[0] else []
            u, v = [of_a[0][i] for i, _ in found], [of_b[0][j] for _, j in found]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for *now, first, node, root, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if len(out := links()):
                        yield out
                    key, of_a, of_b = now, ([], [], []), ([], [], [])
                for kept, x in zip(of_a if first else of_b, (node, root, own), strict=True):
                    kept.append(x)
        if len(out := links()):
            yield out

    a, b = dealt_apart(held, roots, [], "edit", lambda left: masked(nodes.select("node", "fingerprint"), left, "node"))
    side = lambda x, s: x.select("key", "i", "k", F.lit(s == "a").alias("first"), *(F.col(f"{s}_{c}").alias(c) for c in ("node", "root", "fingerprint")))
    both = side(a, "a").unionByName(side(b, "b")).repartition("key", "i", "k").sortWithinPartitions("key", "i", "k")
    return both.mapInArrow(run, "u long, v long").distinct()


def node_of() -> Column:
    return F.xxhash64("fingerprint").alias("node")


def near_duplicates(marked: DataFrame, least: float = 0.8) -> DataFrame:
    """Of rows (doc_id, fingerprint): rows (doc_id, class_id), one a row; the smallest doc_id of those joined to it."""
    return marked.select("doc_id", node_of()).join(near_classes(marked, least), "node").select("doc_id", "class_id")


def near_classes(marked: DataFrame, least: float = 0.8) -> DataFrame:
    """Of rows (doc_id, fingerprint): rows (node, class_id), one a distinct fingerprint.

    Equal fingerprints are one node, known by their hash, so that rows without doc_id take part; a class of such rows
    alone has a null class_id. Every bucket's nodes are held against its smallest one, which is linear, then those
    that are still in different classes against each other; what likeness() says is ``least`` or more is linked.
    """
    nodes = cut(marked.groupBy(node_of(), "fingerprint").agg(F.min("doc_id").alias("least")), "edit-nodes", "gzip")
    # a text of under eight samples is like others of few samples only: they differ in fewer samples than there are pieces
    few = int((BAND - 1) / least + 1e-9)
    cuts = np.linspace(0, few, min(few, int((1 - least) * few + 1e-9) + 1) + 1).astype(int).tolist()
    pieces = F.array(*(F.xxhash64(F.lit(-1 - i), F.substring("fingerprint", a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))))
    short = nodes.where(F.substring("fingerprint", few + 1, 1).isin("", ".")).select(F.explode(pieces).alias("key"), "node")
    spread = bands_of(nodes).unionByName(short)
    many = swept(cut(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "edit-keys"))
    # the walk's length, from the samples that it reaches: texts are like only if the shorter one's is ``least`` of it
    top = F.greatest(F.ceil(F.length("fingerprint") / SAMPLES) - 1, F.lit(0))
    reach = (F.length(F.regexp_replace("fingerprint", "[.]", "")) - top * SAMPLES) / SAMPLES
    size = F.when(top == 0, FIRST * reach).otherwise(F.pow(F.lit(2.0), top - 1) * FIRST * (1 + reach)).alias("size")
    sized = nodes.select("node", size)
    held = cut(masked(spread, many, "key").join(many, "key").join(sized, "node"), "edit-buckets")
    close = lambda x, y: f"least({x}, {y}) >= {least - 0.1!r} * greatest({x}, {y}) - 16"  # noqa: E731  the length is an estimate
    first = held.where("node <> head").select("node", "head", "size").join(sized.select(F.col("node").alias("head"), F.col("size").alias("head_size")), "head").where(close("size", "head_size"))
    first = first.select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")).distinct()

    def linked(pairs):
        side = lambda u, a: nodes.select(F.col("node").alias(u), F.col("fingerprint").alias(a))
        return swept(cut(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(like, "u long, v long"), "edit-links"))

    def like(batches):
        for batch in batches:
            u, v, a, b = (batch.column(k).to_pylist() for k in ("u", "v", "a", "b"))
            keep = [i for i in range(len(u)) if likeness(a[i], b[i]) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=["u", "v"])

    roots = components(linked(first), "edit-components", FEW_LINKS)
    # of the rest only what may be like, as far as sketches of the three last ranges tell: few pairs more than are
    of = ["top", "c", *(f"s{d}{i}" for d in range(3) for i in range(4))]
    several, near = cut(held.where("n > 2").select("key", "node").join(sketches(nodes), "node"), "edit-several"), may_be_like(least)
    for turn in range(HEADS):  # linear again: another member of each bucket that is still in several classes
        named = several.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = named.groupBy("key", "root").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("head"))
        ranked = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("most"), F.count("*").alias("classes")).where("classes > 1")
        # the largest class but one gives the head
        other = sizes.join(ranked, "key").where("root <> most").groupBy("key").agg(F.max_by("head", F.struct("size", "root")).alias("head"), F.max_by("root", F.struct("size", "root")).alias("head_root"))
        heads = cut(other.join(sketches(nodes).withColumnRenamed("node", "head"), "head").select("key", "head", F.col("head_root").alias("b_root"), *(F.col(c).alias(f"b_{c}") for c in of)), "edit-heads")
        if heads.isEmpty():
            break
        members = named.select("key", "node", F.col("root").alias("a_root"), *(F.col(c).alias(f"a_{c}") for c in of))
        pairs = members.join(heads, "key").where(f"a_root <> b_root and {near}").select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")).distinct()
        more = linked(pairs)
        if more.isEmpty():
            break
        roots = components(roots.select("u", F.col("root").alias("v")).unionByName(more), "edit-components", FEW_LINKS)
    more = swept(cut(joined(several.select("key", "node"), roots, nodes, least), "edit-links"))
    if not more.isEmpty():
        roots = components(roots.select("u", F.col("root").alias("v")).unionByName(more), "edit-components", FEW_LINKS)
    rooted = nodes.select("node", "least").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return cut(rooted.join(named, "root").select("node", "class_id"), "edit-classes")


def report(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """edited_and_next() with one more column, class_id: the class of the row's fingerprint, see near_classes()."""
    rows = swept(cut(edited_and_next(docs), "edit-rows", "gzip"))
    return rows.withColumn("node", F.xxhash64("fingerprint")).join(near_classes(rows, least), "node").drop("node")
