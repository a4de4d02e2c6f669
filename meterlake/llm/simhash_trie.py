"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits over 3-word shingles. Equal fingerprints are grouped first; distinct ones are joined at
``errors`` differing bits or fewer. Of ``errors`` + 1 blocks of bits one at least agrees between two such fingerprints,
so each goes to one trie for each block, keyed by the block's bits: every link meets in some trie. A trie of more than
HOT fingerprints is split by the same rule: its fingerprints, which agree in the key's bits, go to a smaller trie for
each of ``errors`` + 1 blocks of the other bits. A task walks pairs of trie nodes together from the roots down: it
adds the bits in which the nodes' paths differ and drops a pair once more than ``errors`` differ, or once both nodes
lie in one group already; only two single fingerprints are compared by the rest of their paths. Each task keeps a
spanning forest of what it linked; components() joins the forests of all tasks.

Cases: a null or empty text, or one of white space alone, has fingerprint zero and links like any other; texts of
one or two words are one shingle; repeated rows share their fingerprint; a null doc_id takes part in groups and is
never a group's id unless nothing else is there (component_id null); an empty table gives an empty result; other
columns are ignored by fingerprints() and kept by one_of_each().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import components, cut, doc_keys, shield, told, unshield

SEED = 42
#: Fingerprints of a trie that one task walks; how often larger ones are split.
HOT, SPLITS = 1 << 18, 4


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed number."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    # the words joined by spaces: a shingle is a slice
    shingles = [b" ".join(w) for w in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows (doc_id, fp long, and the columns ``keep``, which are longs)."""
    names = ["doc_id", *keep]
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "fp", *keep)])

    def run(batches):
        for batch in batches:
            fp = pa.array([fingerprint(x) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp, *(batch.column(k) for k in keep)], schema=schema)

    return docs.select(*names, "text").mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


class Forest:
    """Union-find over positions, with the roots of all of them at hand."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def steps(self) -> np.ndarray:
        """At i: how often the root changes up to position i; equal at both ends of a range: all one group."""
        up = np.asarray(self.up)
        while not np.array_equal(up, up[up]):
            up = up[up]
        return np.concatenate([[0], np.cumsum(up[1:] != up[:-1])]), up


def trie_links(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, errors: int, most: int = 1 << 16) -> list[tuple[int, int]]:
    """Positions linked, as a spanning forest. values: uint64, ascending within each range [start, end): a trie each."""
    forest, n = Forest(len(values)), len(values)
    below: dict[int, np.ndarray] = {}

    def ones(depth: int) -> np.ndarray:
        if depth not in below:
            below[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return below[depth]

    def pairs(depth, *columns):
        for at in range(0, len(columns[0]), most):
            stack.append((depth, *(c[at : at + most] for c in columns)))

    stack: list = []
    pairs(0, starts, ends, starts, ends, np.zeros(len(starts), np.int64))
    steps, up = forest.steps()
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        # both nodes within one group: nothing new below
        open_ = ~((up[a0] == up[b0]) & (steps[a0] == steps[a1 - 1]) & (steps[b0] == steps[b1 - 1]))
        a0, a1, b0, b1, err = (x[open_] for x in (a0, a1, b0, b1, err))
        few = (a1 - a0) * (b1 - b0) == 1  # two leaves: what is left of their paths
        if few.any():
            p0, p1, q0, q1 = (x[few] for x in (a0, a1, b0, b1))
            size = (p1 - p0) * (q1 - q0)
            each = np.repeat(np.arange(len(size)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = p0[each] + k // (q1 - q0)[each], q0[each] + k % (q1 - q0)[each]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= errors)
            was = len(forest.links)
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                forest.link(x, y)
            if len(forest.links) != was:
                steps, up = forest.steps()
            a0, a1, b0, b1, err = (x[~few] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        c = ones(depth)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        own = (a0 == b0) & (a1 == b1)
        children = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1)]
        for which, (x0, x1, y0, y1, e) in enumerate(children):
            keep = (x1 > x0) & (y1 > y0) & (e <= errors)
            if which == 3:
                keep &= ~own  # the mirror of the third
            if keep.any():
                pairs(depth + 1, x0[keep], x1[keep], y0[keep], y1[keep], e[keep])
    return forest.links


def block_masks(bits: list[int], errors: int) -> list[int]:
    """``bits`` as errors + 1 masks of neighbouring ones."""
    edge = [round(len(bits) * i / (errors + 1)) for i in range(errors + 2)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edge, edge[1:])]


def tries(distinct: DataFrame, errors: int) -> DataFrame:
    """Rows (trie, key, fp): the tries that each fingerprint is in."""
    long_ = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    masks = block_masks(list(range(64)), errors)
    here = lambda found: F.explode(F.array(*(F.struct(F.lit(t).alias("trie"), F.col("fp").bitwiseAND(long_(m)).alias("key")) for t, m in found))).alias("k")
    rows, done = distinct.select("fp", here(list(enumerate(masks)))).select("k.*", "fp"), None
    for level in range(SPLITS):
        rows = cut(rows, "simhash-tries")
        hot = rows.groupBy("trie", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("trie", "key")
        if hot.isEmpty():
            break
        hot = cut(hot, "simhash-hot")
        cold = rows.join(hot, ["trie", "key"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        finer = []  # of each trie's bits that its key doesn't hold: blocks again
        for m in masks:
            rest = [b for b in range(64) if not m >> b & 1]
            finer.append([m | x for x in block_masks(rest, errors)])
        apart = F.lit(None)
        first, next_ = level * 10_000, (level + 1) * 10_000  # tries of two levels have different numbers
        for t, some in enumerate(finer):
            new = F.array(*(F.struct(F.lit(next_ + t * (errors + 1) + i).alias("trie"), F.col("fp").bitwiseAND(long_(m)).alias("key")) for i, m in enumerate(some)))
            apart = F.when(F.col("trie") == first + t, new).otherwise(apart)
        rows = rows.join(hot, ["trie", "key"], "left_semi").select("fp", F.explode(apart).alias("k")).select("k.*", "fp")
        masks = [m for some in finer for m in some]
    return rows if done is None else done.unionByName(rows)


def near_links(distinct: DataFrame, errors: int = 3) -> DataFrame:
    """Links (u, v) between the distinct fingerprints in column fp: as a forest that joins all within ``errors`` bits."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(trie, key, fp):
        new = np.flatnonzero(np.concatenate([[True], (trie[1:] != trie[:-1]) | (key[1:] != key[:-1])]))
        starts, ends = new, np.append(new[1:], len(fp))
        many = ends - starts > 1
        starts, ends = starts[many], ends[many]
        if not len(starts):
            return None
        size = ends - starts
        to = np.cumsum(size)
        rows = np.repeat(starts - (to - size), size) + np.arange(to[-1])
        values = fp[rows].view(np.uint64)
        order = np.lexsort((values, np.repeat(np.arange(len(size)), size)))  # unsigned order within each trie
        values = values[order]
        links = np.array(trie_links(values, to - size, to, errors), np.int64).reshape(-1, 2)
        found = values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[links[:, 0]]), pa.array(found[links[:, 1]])], schema=schema)

    def run(batches):
        held: list = []  # pieces; the last trie in them may go on
        rows = 0
        for batch in batches:
            trie, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if rows + len(fp) >= 200_000:
                other = np.flatnonzero((trie != trie[-1]) | (key != key[-1]))
                end = other[-1] + 1 if len(other) else 0
                if not end and held and (held[-1][0][-1] != trie[-1] or held[-1][1][-1] != key[-1]):
                    whole = held  # the batch is one new trie
                elif end:
                    whole = [*held, (trie[:end], key[:end], fp[:end])]
                else:
                    whole = None
                if whole:
                    if (out := link(*(np.concatenate(x) for x in zip(*whole, strict=True)))) is not None:
                        yield out
                    held, rows, trie, key, fp = [], 0, trie[end:], key[end:], fp[end:]
            held.append((trie, key, fp))
            rows += len(fp)
        if rows and (out := link(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield out

    spread = tries(distinct, errors)
    return spread.repartition("trie", "key").sortWithinPartitions("trie", "key", "fp").mapInArrow(run, "u long, v long")


def groups(marked: DataFrame, errors: int = 3) -> DataFrame:
    """Of rows with (doc_id, fp): rows (fp, component_id), one a distinct fingerprint."""
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), errors), "simhash-links").withColumnRenamed("u", "fp")
    rooted = cut(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, errors: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one an input row."""
    marked = cut(fingerprints(docs), "simhash")
    found = groups(marked, errors)
    return marked.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, errors: int = 3) -> DataFrame:
    """The rows of ``docs`` without the later members of each group; the smallest doc_id stays.

    Repeated rows of that doc_id are one document and stay once; a group without any doc_id keeps one row.
    """
    own = shield(docs, "doc_id", "text")
    keyed = own.select("*", *doc_keys(own))
    marked = cut(fingerprints(keyed, "_key_id", "_key_text"), "simhash")
    found = groups(marked, errors)
    kept = marked.join(found, "fp").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min(F.struct("_key_id", "_key_text")).alias("k"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("_key_id", "_key_text"))).alias("named"))
    kept = kept.select(F.coalesce("named", "k").alias("k")).select("k.*")
    kept = cut(kept, "simhash-kept")
    same = ["_key_id", "_key_text"]
    # only texts that may go, or that are repeated, are shuffled
    doubtful = marked.groupBy(*same).agg(F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), same, "left").where("n > 1 or kept is null").select(*same)
    split = told(keyed, doubtful, *same)
    checked = split.where("_may").drop("_may").join(kept, same, "left_semi").dropDuplicates(same)
    return unshield(split.where("not _may").drop("_may").unionByName(checked), docs, "doc_id", "text")
