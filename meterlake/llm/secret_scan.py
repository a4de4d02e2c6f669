"""Secret scan with corpus-wide ownership frequency.

Three base kinds are found by pattern. Tokens that look like credentials (letters and digits mixed) without a
keyword beside them are further candidates. Candidates are hashed, and the corpus is asked how many distinct
repositories and owners hold each hash: what three or more owners hold is a copied example, the rest is
owner-specific, and counts as live where the value looks like a credential in use (live_looking()). A bare candidate is added to the spans if the same value is a base finding somewhere in the corpus
or, with both letter cases and high entropy, if it is owner-specific. Base spans always stay.

Texts are read once and never shuffled; only hashes, spans and counts are. Counts are summed per (hash,
repository) before the shuffle, so that a secret in a third of all rows costs one row a task.

Cases: a null text is empty; a null source is an owner of its own; a source without "/" is its own owner; repeated
rows are scanned as often as they occur and count once a repository; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut

KINDS = ("assign", "access", "hex", "bare")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BARE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{12,}(?![A-Za-z0-9+/_=-])")


def entropy(x: str) -> float:
    """Bits a character."""
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, index of the kind, end, value), in that order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


# What stands in examples in place of a secret.
PLACEHOLDERS = ("example", "changeme", "change_me", "password", "passwd", "secret", "dummy", "sample", "placeholder", "your", "xxxx", "0000", "1234567", "abcdef", "test", "foobar", "redacted", "insert", "todo")


def live_looking(x: str) -> bool:
    """Whether a value looks like a credential in use: long, of letters and digits, varied, and no placeholder."""
    if len(x) < 12 or sum(c.isdigit() for c in x) < 2 or sum(c.isalpha() for c in x) < 2 or entropy(x) < 3:
        return False
    low = x.lower()
    return not any(p in low for p in PLACEHOLDERS)


def bare_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str, bool]]:
    """Credential-shaped tokens outside the base spans; the flag: strong enough to stand without a base finding."""
    out, at, reached = [], 0, 0  # both run in the order of their starts
    for m in BARE.finditer(text):
        x = m[0]
        while at < len(base) and base[at][0] < m.end():
            reached, at = max(reached, base[at][2]), at + 1
        digits = sum(c.isdigit() for c in x)
        if digits < 3 or sum(c.isalpha() for c in x) < 3 or reached > m.start():
            continue
        strong = len(x) >= 20 and re.search("[a-z]", x) is not None and re.search("[A-Z]", x) is not None and entropy(x) >= 3.5
        out.append((m.start(), 3, m.end(), x, strong))
    return out


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big", signed=True)


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def scan(docs: DataFrame, common_owners: int = 3) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_repeated), one an input row.

    n_live: findings of fewer owners than ``common_owners`` that look live; n_example: of as many or more; n_repeated:
    whose value stands in more than one place of the corpus.
    """
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64()), ("strong", pa.bool_()), ("live", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("repo", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(span))])

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, repo in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "source")), strict=True):
                base = base_spans(text or "")
                n = Counter(k for _, k, _, _ in base)
                found = [{"start": s, "kind": k, "end": e, "hash": _hash(v), "strong": True, "live": live_looking(v)} for s, k, e, v in base]
                found += [{"start": s, "kind": k, "end": e, "hash": _hash(v), "strong": strong, "live": live_looking(v)} for s, k, e, v, strong in bare_spans(text or "", base)]
                out.append({"doc_id": doc, "repo": repo or "", "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(_text(base).encode()).hexdigest(), "found": found})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ddl = "doc_id long, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: long, kind: int, end: long, hash: long, strong: boolean, live: boolean>>"
    rows = cut(docs.select("doc_id", "text", "source").mapInArrow(run, ddl).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.select("row", "repo", F.explode("found").alias("f")).select("row", "repo", "f.*")
    owner = F.substring_index("repo", "/", 1)
    by_repo = each.groupBy("hash", owner.alias("owner"), "repo").agg(F.max(F.col("kind") < 3).alias("base"), F.count("*").alias("places"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("base").alias("base"), F.sum("places").alias("places"))
    spread = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("base").alias("base"), F.sum("places").alias("places"))
    judged = each.join(spread, "hash").where((F.col("kind") < 3) | F.col("base") | (F.col("strong") & (F.col("owners") < common_owners)))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    # a document's own findings, in order
    held = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("s")))).alias("a"),
        F.count_if((F.col("owners") < common_owners) & F.col("live")).alias("live"),
        F.count_if(F.col("places") > 1).alias("repeated"),
        F.count_if(F.col("owners") >= common_owners).alias("example"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(held, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.concat_ws(",", F.transform("a", lambda x: x["s"])), F.lit("")).alias("spans"),
        F.coalesce("live", zero).alias("n_live"), F.coalesce("example", zero).alias("n_example"), F.coalesce("repeated", zero).alias("n_repeated"),
    )
