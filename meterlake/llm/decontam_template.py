"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: a number becomes <num>, a unit after a number <unit>, a capitalised word <name> (at the start
of a sentence unless it is one of the words that often open one); case and punctuation at the ends go. Windows of five
canonical words are hashed; those of placeholders alone, such as a row of numbers, say nothing and are left out where
an item has others. A document's windows that
pass a filter of fixed size are hash-joined with the benchmark's windows; a document and an item match where the
windows found cover at least ``coverage`` of the item's. Then the slots are checked: along the alignment, each value
in an item's slots has to stand for one value in the document (a question with its numbers and names exchanged is
consistent, a chance meeting of templates isn't), again at ``coverage`` of the slots.

A document is read once in a Python worker; what leaves it is a row for each window that the benchmark may hold. Items
equal in template and slot values are one class, held by its smallest item_id, so that repeated items don't multiply
rows; item_classes() tells each item's class. Windows are found once a template, the slots are checked for each class. A
window in a third of all documents costs each document one row. No text is shuffled, and what is broadcast is the
filter: at most 2^21 bits.

Cases: a null or empty text has no windows and is clean; an item of fewer than five words is one window of its
length; an item without words matches nothing; repeated rows are judged alike; an empty benchmark leaves all clean;
an empty table gives an empty result; other columns are kept by drop_contaminated() and ignored by matches().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, doc_keys, shield, told, unshield

# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent degree degrees c f k "
    "hz khz mhz ghz w kw kwh v a b kb mb gb tb usd eur gbp dollar dollars cent cents euro euros pound pounds mph kmh kph m/s km/h".split()
)
# Words that open sentences and are no names.
OPENERS = frozenset(
    "a about after all also although an and another any are as at because before both but by can could did do does during each either every few find first for from given had has have he her here his how "
    "however i if in instead into is it its last later let many more most much my neither next no nor not now of on once one only or other our over she should since so some such suppose than that the their "
    "them then there therefore these they this those though three through thus to two under until we well were what when where whether which while who whose why will with without would yes yet you your "
    "compute calculate determine show prove write explain describe solve evaluate simplify draw list name state assume consider "
    "der die das ein eine er sie es wir ihr ich und oder aber wenn als wie was wer wo warum in im am auf mit von zu nach bei für ist sind war "
    "le la les un une il elle ils elles nous vous je et ou mais si quand comme dans sur avec de du des pour par est sont "
    "el los las uno una ellos ellas nosotros yo y o pero cuando como en con del para por es son".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d_]+|%)")
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”‘’«»¿¡…–—"
NUM, UNIT, NAME = (xxhash.xxh64_intdigest(x, 7) for x in ("<num>", "<unit>", "<name>"))
#: Bits of the filter of window hashes; words whose canonical form a worker keeps.
FILTER_BITS, CACHE_WORDS = 1 << 21, 700_000
WINDOW = 5


class Canon:
    """Words to numbers: (hash within a sentence, hash at its start, hash of the value, class) and whether a sentence ends.

    Classes: 0 a word, 1 a number, 2 a unit's word, 3 a name unless at the start, 4 a number with its unit, 5 nothing, 6 a name.
    """

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros((3, CACHE_WORDS), np.uint64)  # at a word's number: the three hashes
        self.traits = np.zeros((2, CACHE_WORDS), np.int8)  # its class, whether a sentence ends

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, in a table that starts anew when it is full."""
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = {w for w in words if w not in known}
        if len(known) + len(new) > self.hashes.shape[1]:
            known.clear()
            new = set(words)
            if len(new) > self.hashes.shape[1]:
                self.hashes, self.traits = np.zeros((3, len(new)), np.uint64), np.zeros((2, len(new)), np.int8)
        first = len(known)
        facts = list(map(self.look, new))
        known.update(zip(new, range(first, first + len(new))))
        *hashes, kind, ends = zip(*facts, strict=True)
        self.hashes[:, first : len(known)] = np.array(hashes, np.uint64)
        self.traits[:, first : len(known)] = kind, ends
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def look(self, raw: bytes) -> tuple[int, int, int, int, int]:
        word = raw.decode("utf-8", "replace")
        if word.isalpha():
            core, ends = word, 0
        else:
            core, ends = word.strip(EDGE), int(word.rstrip("\"')”’»").endswith((".", "!", "?", ":", "…")))
        if "%" in word and core:
            core += "%" * word.rstrip(".,;:!?)\"'").endswith("%")
        low = core.lower()
        plain = xxhash.xxh64_intdigest(low.encode("utf-8", "replace"), 7)
        if not core:
            return 0, 0, 0, 5, ends
        if not core.isalpha():
            if NUMBER.fullmatch(core):
                return NUM, NUM, plain, 1, ends
            if (glued := GLUED.fullmatch(core)) and glued[2].lower() in UNITS:
                return NUM, NUM, plain, 4, ends
        if low in UNITS:
            return plain, plain, plain, 2, ends
        if core[0].isupper() and core[1:] == core[1:].lower():
            return (NAME, plain, plain, 3, ends) if low in OPENERS else (NAME, NAME, plain, 6, ends)
        return plain, plain, plain, 0, ends

    def windows(self, text: str, sizes: tuple[int, ...]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """For each size the windows' hashes; of each canonical word its value's hash and whether it is a slot."""
        lines = text.encode("utf-8", "replace").split(b"\n")
        words, start = [], []
        for line in lines:
            own = line.split()
            if own:
                start.append(len(words))
                words += own
        n = len(words)
        if not n:
            return {k: np.zeros(0, np.uint64) for k in sizes}, np.zeros(0, np.uint64), np.zeros(0, bool)
        at = self.numbers(words)
        mid, first, value = (x[at] for x in self.hashes)
        kind, ends = (x[at] for x in self.traits)
        opens = np.zeros(n, bool)
        opens[start] = True
        opens[1:] |= ends[:-1] > 0
        kind = np.where((kind == 3) & opens, 0, kind)
        canon = np.where(opens, first, mid)
        there = kind != 5
        canon, value, kind = canon[there], value[there], kind[there]
        after = np.concatenate([[False], kind[:-1] == 1]) if len(kind) else np.zeros(0, bool)
        unit = after & (kind == 2)
        canon = np.where(unit, np.uint64(UNIT), canon)
        slot = (kind == 1) | (kind == 3) | (kind == 4) | (kind == 6) | unit
        out = {}
        with np.errstate(over="ignore"):
            for k in sizes:
                m = max(0, len(canon) - k + 1)
                h = np.full(m, k, np.uint64)
                for i in range(k):
                    h = (h ^ canon[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out[k] = h
        return out, value, slot


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Rows (template, variant, item_id, n, pos, size, h, slots array<long>), one a window of an item; variant tells slot values apart."""
    schema = pa.schema([("template", pa.int64()), ("variant", pa.int64()), ("item_id", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("size", pa.int32()), ("h", pa.int64()), ("slots", pa.list_(pa.int64()))])

    def run(batches):
        canon = Canon()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by, value, slot = canon.windows(text or "", (1, 2, 3, 4, 5))
                size = min(WINDOW, len(value))
                if size:
                    held = np.where(slot, value, 0).view(np.int64)
                    whole, variant = (x - (1 << 64 if x >> 63 else 0) for x in (xxhash.xxh64_intdigest(a.tobytes(), 9) for a in (by[1], held)))
                    # windows with a word of their own, if there are any
                    own = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(~slot, size).any(axis=1))
                    own = own if len(own) else np.arange(len(by[size]))
                    for pos, h in zip(own.tolist(), by[size].view(np.int64)[own].tolist(), strict=True):
                        out.append({"template": whole, "variant": variant, "item_id": item, "n": len(own), "pos": pos, "size": size, "h": h, "slots": held[pos : pos + size].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return benchmark.select("item_id", "text").mapInArrow(run, "template long, variant long, item_id long, n long, pos long, size int, h long, slots array<long>")


def _least() -> Column:
    return F.min(F.coalesce("item_id", F.lit(2**63 - 1))).alias("class")


def item_classes(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, class_id) of all items with words: the item_id under which matches() reports an item."""
    each = cut(item_windows(benchmark).select("template", "variant", "item_id").distinct(), "templates")
    named = each.join(each.groupBy("template", "variant").agg(_least()), ["template", "variant"])
    return named.select("item_id", F.when(F.col("class") < 2**63 - 1, F.col("class")).alias("class_id"))


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """Rows (_key_id, _key_text, item_id, found, coverage, slots, consistent) of what is contaminated; docs has the keys."""
    spark = docs.sparkSession
    items = cut(item_windows(benchmark), "templates")
    same = ["template", "variant"]
    items = items.join(items.groupBy(*same).agg(_least()), same).where("coalesce(item_id, 9223372036854775807) = class")
    items = cut(items.dropDuplicates([*same, "pos"]), "templates")
    templates = cut(items.dropDuplicates(["template", "pos"]), "templates")
    sizes = tuple(sorted(r.size for r in templates.select("size").distinct().collect()))  # at most five numbers
    bits = np.zeros(FILTER_BITS, bool)
    for r in templates.select((F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))).alias("b")).distinct().toLocalIterator():
        bits[r.b] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))
    schema = pa.schema([("_key_id", pa.int64()), ("_key_text", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("held", pa.list_(pa.int64()))])

    def run(batches):
        canon, mask = Canon(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                ids, keys, texts = (part.column(k).to_pylist() for k in ("_key_id", "_key_text", "text"))
                out = []
                for i, k, text in zip(ids, keys, texts, strict=True):
                    by, value, slot = canon.windows(text or "", sizes)
                    held = np.where(slot, value, 0).view(np.int64)
                    for size, h in by.items():
                        for at in np.flatnonzero(mask[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64)]).tolist():
                            out.append({"_key_id": i, "_key_text": k, "at": at, "h": h[at : at + 1].view(np.int64)[0], "held": held[at : at + size].tolist()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    probes = docs.select("_key_id", "_key_text", "text").mapInArrow(run, "_key_id long, _key_text long, at long, h long, held array<long>")
    probes, doc, pair = cut(probes, "template-probes"), ["_key_id", "_key_text"], ["_key_id", "_key_text", "template"]
    # a document's distinct windows first: a row for each template that has one, wherever and how often it stands
    known = templates.groupBy("template", "n", "h").agg(F.count("*").alias("m"))
    met = probes.select(*doc, "h").distinct().join(known, "h").groupBy(*pair, "n").agg(F.sum("m").alias("found"))
    enough = cut(met.where(F.col("found") >= F.lit(coverage) * F.col("n")), "template-met")
    # the places only of what is covered
    hits = probes.join(enough.select(*pair), doc).join(templates.select("template", "h", "pos", "slots"), ["template", "h"])
    # what stands in the document at each slot and in how many windows; where the slots are is the template's
    met = hits.select(*pair, (F.col("at") - F.col("pos")).alias("shift"), "pos", F.posexplode(F.arrays_zip("slots", "held")).alias("i", "z"))
    met = met.where("z.slots <> 0").groupBy(*pair, "shift", (F.col("pos") + F.col("i")).alias("place"), F.col("z.held").alias("d")).agg(F.count("*").alias("c"))
    # against the values of each class of the template
    values = items.select(*same, "pos", F.posexplode("slots").alias("i", "s")).where("s <> 0").select(*same, (F.col("pos") + F.col("i")).alias("place"), "s").distinct()
    met, pair = met.join(values, ["template", "place"]), [*pair, "variant"]
    agree = met.groupBy(*pair, "shift", "s", "d").agg(F.sum("c").alias("c")).groupBy(*pair, "shift", "s").agg(F.max("c").alias("best"), F.sum("c").alias("all"))
    agree = agree.groupBy(*pair, "shift").agg(F.sum("best").alias("best"), F.sum("all").alias("all")).groupBy(*pair).agg(F.max(F.struct("all", "best")).alias("m")).select(*pair, "m.*")
    name = items.select(*same, "item_id").distinct()
    judged = enough.join(name, "template").join(agree, pair, "left").withColumn("consistent", F.coalesce(F.col("best") / F.col("all"), F.lit(1.0)))
    return judged.where(F.col("consistent") >= coverage).select("_key_id", "_key_text", "item_id", "found", (F.col("found") / F.col("n")).alias("coverage"), F.coalesce("all", F.lit(0)).cast("long").alias("slots"), "consistent")


def report(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """Rows (doc_id, contaminated, n_items, item_id, item_coverage), one an input row; the item covered best."""
    keyed = docs.select("doc_id", "text", *doc_keys(docs))
    found = matches(keyed, benchmark, coverage).groupBy("_key_id", "_key_text").agg(F.count("*").alias("n_items"), F.max_by(F.struct("item_id", "coverage"), F.struct("coverage", -F.col("item_id"))).alias("best"))
    rows = keyed.select("doc_id", "_key_id", "_key_text").join(found, ["_key_id", "_key_text"], "left")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("best.item_id").alias("item_id"), F.coalesce(F.col("best.coverage"), F.lit(0.0)).alias("item_coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, windows, item_coverage, slots, consistent): each document with each item that it holds."""
    keyed = docs.select("doc_id", *doc_keys(docs), "text")
    found = matches(keyed, benchmark, coverage)
    named = keyed.select("doc_id", "_key_id", "_key_text").join(found, ["_key_id", "_key_text"])
    return named.select("doc_id", "item_id", F.col("found").alias("windows"), F.col("coverage").alias("item_coverage"), "slots", "consistent")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without contaminated documents."""
    own = shield(docs, "doc_id", "text")
    keyed = own.select("*", *doc_keys(own))
    bad = cut(matches(keyed, benchmark, coverage).select("_key_id", "_key_text").distinct(), "template-bad")
    split = told(keyed, bad, "_key_id", "_key_text")  # only texts that may be bad are shuffled
    doubtful = split.where("_may").drop("_may").join(bad, ["_key_id", "_key_text"], "left_anti")
    return unshield(split.where("not _may").drop("_may").unionByName(doubtful), docs, "doc_id", "text")
