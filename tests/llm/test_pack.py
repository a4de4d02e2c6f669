import random
import struct
import zlib

import public_tokenizers
import pytest
from helpers import docs, sample
from tokenizers import Tokenizer

from meterlake.llm.pack_pow2 import pack, piece_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_piece_lengths():
    for n in [1, 2, 3, 4095, 4096, 4097, 12345, *random.Random(1).sample(range(1, 30000), 50)]:
        got = piece_lengths(n, 4096)
        assert sum(got) == n and all(k & (k - 1) == 0 for k in got) and got == sorted(got, reverse=True)
        assert len([k for k in got if k < 4096]) == len({k for k in got if k < 4096})


def test_ids_come_back_whole(spark):
    own = Tokenizer.from_file(PATH)
    rows = [(r[0], r[1]) for r in sample(150)] + [(900, None), (901, ""), (902, "a b c\x85d  e\x1cf"), (903, "ΟΔΟΣ İstanbul ﬁ é ǅ it's 'LL"), (903, "x"), (904, "word " * 9000), (None, "no id")]
    got = pack(docs(spark, rows), PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in got)
    expected = []
    for i, x in rows:
        ids = own.encode(x or "", add_special_tokens=False).ids + [2]
        at = 0
        for k in piece_lengths(len(ids), 4096):
            expected.append((i, at, k, zlib.crc32(struct.pack(f"<{k}I", *ids[at : at + k])), len(ids)))
            at += k
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in got)


def test_empty_table_and_extra_columns(spark):
    assert pack(docs(spark, []), PATH).count() == 0
    from pyspark.sql import functions as F

    assert pack(docs(spark, [(1, "a b")]).withColumns({"start": F.lit("x"), "sequence_id": F.lit("y")}), PATH).count() == len(piece_lengths(3, 4096))


def test_length_has_to_be_a_power(spark):
    with pytest.raises(ValueError):
        pack(docs(spark, []), PATH, 1000)
