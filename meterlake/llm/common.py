"""Shared pieces of the training-data operators: column naming, lineage cuts, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of star contraction after which a graph counts as broken input; a graph of n nodes needs about log2(n)^2.
MAX_ROUNDS = 200
#: Links of a graph that the driver takes to settle it by itself: 16 bytes each.
FEW_LINKS = 1 << 16
#: Longs of 64 bits in a filter of fixed size that is broadcast: at most so many rows.
FILTER_LONGS = 1 << 16


def shield(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns other than ``used`` named by their place, so that none clashes with an operator's own."""
    return docs.toDF(*(c if c in used else f"_own_{i}" for i, c in enumerate(docs.columns)))


def unshield(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, of a frame that came from shield(docs, *used)."""
    return df.select(*(F.col(c if c in used else f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="meterlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files that outlive executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(df: DataFrame) -> DataFrame:
    """``df``, after a collection of the driver's garbage: Spark removes shuffle files only when it has been made.

    For a step that is done with a large shuffle; on a driver that stays idle nothing else would free the disks.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def released() -> None:
    """Give the memory that a task of Python is done with back to the system.

    For the end of a task: its worker stays for a minute, beside the JVM's work on the next stage, with all that it has kept to use again.
    """
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def told(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``_may``: whether a row's ``columns`` may be among those of ``keys``, by a filter of fixed size, broadcast."""
    hashed = F.xxhash64(*columns)
    word = F.pmod(F.shiftright(hashed, 6), F.lit(FILTER_LONGS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))
    mask = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    found = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(mask), "_word", "left")
    return found.withColumn("_may", F.coalesce(F.col("_mask").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_mask")


def masked(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose ``columns`` may be among those of ``keys``."""
    return told(df, keys, *columns).where("_may").drop("_may")


def doc_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list:
    """Two columns that tell rows apart even when ids repeat or are null; rows equal in both are one document."""
    return [F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("_key_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key_text")]


def settled(edges: DataFrame) -> DataFrame:
    """Rows (u, v) that join each node of few links to the smallest one of its component, found on the driver."""
    table, up = edges.select("u", "v").toArrow(), {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True):
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    found = [(x, r) for x in up if (r := root(x)) != x]
    return edges.sparkSession.createDataFrame(pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([r for _, r in found], pa.int64())}))


def components(links: DataFrame, label: str = "components", few: int = 0) -> DataFrame:
    """Connected components of ``links`` (u long, v long): rows (u, root) for every node, root the smallest node.

    Alternating large-star and small-star contraction. Each half is a minimum per node (combined before the
    shuffle) joined back to the edges, so that no neighbour list is ever gathered and a hub is only a skewed
    join side, which adaptive execution splits. Every round ends in the shared folder. A graph of at most ``few``
    links takes no rounds: a dozen shuffles of next to nothing cost more files and tasks than it has rows.
    """

    def state(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = state(edges)
    here = before[0] <= few
    if before[0] and here:
        edges = cut(settled(edges), label)
    for _ in range(0 if here else MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        if not here:
            raise RuntimeError("components did not settle")
    found = swept(edges).select("u", F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("u"), "root").distinct())


#: Rows of a bucket that one task holds against one another: of those outside its largest group, and of all.
CHUNK_FEW, CHUNK_ALL = 256, 4096
#: What the rows of all in a chunk weigh together, about: they wait in memory for those they meet.
CHUNK_WEIGHT = 1 << 22
#: SQL over both sides of dealt_apart(): of two rows outside the largest group each meets the other, once is enough.
MEETS = "a_root <> b_root and (b_most or a_node < b_node)"


def dealt_apart(held: DataFrame, roots: DataFrame, columns: list[str], label: str, more=None, weight: str = "0", done: str = "null", may: str = "") -> tuple[DataFrame, DataFrame]:
    """What is to be held against each other of rows that share a bucket of ``held`` (key, node, columns) and are in different groups.

    roots: components() so far. more: of the rows (node, buckets) left to be held against others, buckets the keys that
    they are left in, gives rows (node, further columns). Rows outside a bucket's largest group meet all of its rows, in chunks that are dealt to tasks of their own:
    neither a bucket full of copies nor a large bucket makes all its pairs in one task. Returns both sides: rows (key, i, k,
    and with a_ or b_ before their names node, root and the columns), the second with b_most, whether it is of the largest
    group; rows equal in (key, i, k) meet. Of two rows outside the largest group each is on both sides.
    weight: SQL of a row, a bucket that weighs much gets more chunks. done: SQL of a row, of which a bucket's greatest
    tells the row that has met all others of the bucket before; it is left out. may: SQL over the columns with a_ and b_
    before their names; only rows for which it holds with another of their chunk are left, before ``more`` is asked of them.
    """
    named = held.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum(F.expr(weight)).alias("weight"), F.max(F.expr(done)).alias("met"))
    most = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("size", "root")).alias("most"), F.count("*").alias("groups"), F.sum("size").alias("all"), F.max("size").alias("size"),
        F.sum("weight").alias("weight"), F.max("met").alias("met"), F.max_by("size", "met").alias("beside"),
    )
    few, chunks = F.ceil((F.col("all") - F.col("size")) / CHUNK_FEW).cast("int"), F.ceil(F.greatest(F.col("all") / CHUNK_ALL, F.col("weight") / CHUNK_WEIGHT)).cast("int")
    # a group that is the row left out alone doesn't count
    most = most.where("groups - if(coalesce(beside, 0) = 1, 1, 0) > 1").select("key", "most", "met", few.alias("few"), chunks.alias("chunks"))
    left = named.join(most, "key").where(f"not coalesce({done} = met, false)")
    rest = swept(cut(left.select("key", "node", *columns, "root", "most", "few", "chunks"), f"{label}-rest"))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def sides(rest, columns):
        own = ["node", "root", *columns]
        a = rest.where("root <> most").withColumn("i", deal("few")).select("*", upto("chunks").alias("k")).select("key", "i", "k", *(F.col(c).alias(f"a_{c}") for c in own))
        b = rest.withColumn("k", deal("chunks")).select("*", upto("few").alias("i")).select("key", "i", "k", (F.col("root") == F.col("most")).alias("b_most"), *(F.col(c).alias(f"b_{c}") for c in own))
        return a, b

    if may:
        a, b = sides(rest, columns)
        b = b.withColumnsRenamed({c: f"b_{c}" for c in ("key", "i", "k")})
        meets = F.expr(f"key = b_key and i = b_i and k = b_k and {MEETS} and {may}")
        some = a.join(b, meets, "left_semi").select("key", F.col("a_node").alias("node"))
        some = some.unionByName(b.join(a, meets, "left_semi").select(F.col("b_key").alias("key"), F.col("b_node").alias("node"))).distinct()
        rest = swept(cut(rest.join(some, ["key", "node"], "left_semi"), f"{label}-rest"))
    if more:
        known = more(rest.groupBy("node").agg(F.collect_list("key").alias("buckets")))
        rest, columns = rest.join(known, "node"), [*columns, *(c for c in known.columns if c != "node")]
    return sides(rest, columns)


def still_apart(held: DataFrame, roots: DataFrame, columns: list[str], near: str, label: str, more=None, weight: str = "0", done: str = "null", may: str = "") -> DataFrame:
    """Pairs (u, v), u < v, of what dealt_apart() deals that fulfil ``near``: SQL over key and the columns with a_ and b_ before their names, the same both ways."""
    a, b = dealt_apart(held, roots, columns, label, more, weight, done, may)
    met = a.join(b, ["key", "i", "k"]).where(f"{MEETS} and {near}")
    return met.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct()
