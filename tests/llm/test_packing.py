import random
import zlib
from functools import lru_cache

import numpy as np
from textlens.llm import packing as P
from textlens.llm.bpe import vocabulary_path

from .helpers import ODD, documents, prose
from .test_token_index import TEXTS

SPECIAL = ["a <|endoftext|> b", "x<|startoftext|>y", "<|endof text|>", "Ａ Σ ΑΣ σ́ İ ı", "e ́ a ́", "a\x1cb\x1fc\x85d e　f", "it 's IT'S don' t"]


@lru_cache
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path(P.VOCABULARY))


@lru_cache(10_000)
def whole(text):
    return [*plain().encode(text or "", add_special_tokens=False).ids, P.END]


def test_parts_give_the_ids_of_the_plain_library_call():
    encode = P.encoder(vocabulary_path(P.VOCABULARY)).encode
    for text in [*TEXTS, *SPECIAL, *[t or "" for t in ODD], prose(1, 500)]:
        assert np.frombuffer(encode(text.encode()), "<u2").tolist() == whole(text)[:-1], text[:40]


def test_cuts_cover_each_length_and_fill_their_class():
    for size, slack in ((2048, P.SLACK), (64, 2), (64, 0)):
        for n in range(1, 3 * size):
            parts = P.lengths(n, size, slack)
            assert sum(parts) == n and all(0 < r <= size for r in parts)
            for r in parts:
                k = size // r
                assert size - k * r <= slack or r == size // k, (n, r)


def check(rows, got, size):
    """Every id in one piece, sequences gapless; returns the share of padding."""
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    pad = held = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        held += at
        pad += 0 if at & (at - 1) == 0 else size - at
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(whole(text))
    assert set(by_doc) == set(want)
    for i, texts in want.items():
        assert sum(r["length"] for r in by_doc[i]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                own = texts[0][at:at + r["length"]]
                assert (r["start"], r["doc_tokens"]) == (at, len(texts[0]))
                assert r["ids_crc32"] == zlib.crc32(np.asarray(own, "<u4").tobytes())
                at += r["length"]
    return pad / held


def test_packed_rows_hold_every_id_once(spark):
    rng = random.Random(2)
    texts = [*TEXTS, *SPECIAL, *ODD, *[prose(i, rng.randrange(1, 900)) for i in range(400)]]
    rows = list(enumerate(texts)) + [(5, "again"), (5, "again"), (None, "no id")]
    docs = documents(spark, rows).repartition(7)
    got = P.pieces(P.pack(docs)).collect()
    assert check(rows, got, P.SIZE) < 0.02
    small = P.pieces(P.pack(docs, size=64, slack=1)).collect()
    check(rows, small, 64)


def test_tables_of_one_length_and_none(spark):
    one = [(i, "cat dog") for i in range(1000)]
    got = P.pieces(P.pack(documents(spark, one).repartition(5))).collect()
    assert check(one, got, P.SIZE) < 0.01
    assert all(r["length"] == 3 for r in got if r["sequence_id"] < (1 << 62) + (1 << 61))
    empty = [(i, None) for i in range(50)]
    assert check(empty, P.pieces(P.pack(documents(spark, empty))).collect(), P.SIZE) == 0
    assert P.pieces(P.pack(documents(spark, []))).count() == 0


def test_sequences_are_padded_but_for_powers_of_two(spark):
    rows = [(i, prose(i, 10 + 7 * i)) for i in range(90)]
    for r in P.pack(documents(spark, rows).repartition(3)).collect():
        held = sum(p["length"] for p in r["pieces"])
        n = len(r["ids"]) // 2
        assert n == (held if held & (held - 1) == 0 else P.SIZE)
        assert set(np.frombuffer(r["ids"], "<u2")[held:].tolist()) <= {P.PAD}
