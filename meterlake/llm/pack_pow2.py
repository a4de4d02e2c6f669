"""Packing by power-of-two decomposition.

Each document becomes the ids of its text and a closing id, cut into pieces whose lengths are powers of two: as
many of ``max_length`` as fit, then the binary digits of the rest, largest first. Every piece is a sequence of its
own, so no sequence crosses documents and none is padded; pieces of one length share a bucket. Nothing is
shuffled: a piece is known from its document alone.

Cases: a null or empty text is the closing id alone (one piece of length 1); a text of any length is cut whole;
equal or repeated rows are packed as often as they occur; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids one Python worker keeps; older ones are forgotten all at once. It bounds memory, not results.
CACHE_WORDS = 600_000


def piece_lengths(n: int, most: int) -> list[int]:
    """``n`` as whole pieces of ``most`` (a power of two) and the binary digits of the rest, in falling order."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


#: Texts of these characters alone are split here: none of them changes under NFC, and each lower-cases to one of them.
SIMPLE = re.compile("[\x00-\u012f\u0131-\u017f]*")
# Fixed value: the vocabulary's pre-tokenizer over lower-cased simple characters.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\t-\\r \\x85\\xa0a-z0-9ªµºß-öø-ſ²³¹¼-¾]+")


#: Texts on which the short way has to agree with a vocabulary's own tokenizer before it is taken.
PROBES = ("", "A plain text, with 12 numbers.", "it's  they'll\n\tdon't!!", "ÉCOLE ñandú ½ ª straße 3.14", "x=1;y[2]-->\u00a0z", "<a href='b'>c</a> #tag @name 100%")


def byte_letters() -> list[str]:
    """How byte-level vocabularies write each byte: itself where printable, else the next letter from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes.

    The vocabulary is applied to each pre-token on its own, so each distinct one needs that only once. Texts
    with characters beyond SIMPLE, or with what may be a special token, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own, self.known, self.letters, self.simple = Tokenizer.from_file(path), {}, byte_letters(), True
        self.simple = all(self.encode(x) == self.whole(x) for x in PROBES)  # else this vocabulary splits texts in another way

    def whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.own.model.tokenize(piece))

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.simple or not SIMPLE.fullmatch(text) or "<|" in text:
            return self.whole(text)
        pieces = PIECES.findall(text.lower())
        known = self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            new = {w for w in pieces if w not in known}
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(pieces)
        for w in new:
            known[w] = self.ids(w)
        return b"".join(map(known.__getitem__, pieces))


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = 4096, end_id: int = 2) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket), one a piece.

    ``bucket`` is log2 of the length. ``sequence_id`` is unique: the partition's number and a count within it.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length has to be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in batches:
            ids, texts = (batch.column(k).to_pylist() for k in ("doc_id", "text"))
            for at in range(0, len(ids), 500):
                out = [[] for _ in names]
                for doc, text in zip(ids[at : at + 500], texts[at : at + 500], strict=True):
                    body = tokenizer.encode(text) + end
                    n, start = len(body) // 4, 0
                    for k in piece_lengths(n, max_length):
                        for column, x in zip(out, (doc, start, k, zlib.crc32(memoryview(body)[4 * start : 4 * (start + k)]), n), strict=True):
                            column.append(x)
                        start += k
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    pieces = docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder a length, so that a training run draws batches of equal lengths."""
    pieces.write.partitionBy("bucket").mode("overwrite").parquet(path)
