import zlib
from functools import lru_cache

import numpy as np
from textlens.llm import bpe
from textlens.llm import token_index as T

from .helpers import ODD, documents, prose

TEXTS = ["a  b", " \n x", "don't we'll 'S", " lead", "trail ", "tab\tx \t y", "　x y　 z", "été 12½ ²", "日本語 text <|endoftext|> a", "a  <|endoftext|>", "x<|endoftext|>  y", "<|endoftext|", "a <|endoftext|>\n b",
         "\x1cq \x1c q \x85 w", "x  y  z", " " * 9 + "k", "a\r\n b", "ǅ ʼn 𝒳 a", "İ ı ſ K", "é a‍b ﻿ x", "١٢٣ ①②"]


@lru_cache
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.vocabulary_path())


def whole(text):
    return plain().encode(text or "", add_special_tokens=False).ids


def test_parts_give_the_ids_of_the_whole_text():
    encode = bpe.encoder(bpe.vocabulary_path()).encode
    for text in [*TEXTS, *[t or "" for t in ODD], prose(1, 500)]:
        assert np.frombuffer(encode(text), "<u2").tolist() == whole(text), text[:40]


def test_written_indexed_and_read_back(spark):
    rows = list(enumerate([*TEXTS, *ODD, *[prose(i, 30) for i in range(80)]]))
    rows += [(5, "again"), (5, "again"), (None, "no id")]
    got = sorted(map(tuple, T.token_table(documents(spark, rows).repartition(6)).collect()), key=lambda r: r[1])
    assert len(got) == len(rows)
    at, by = 0, {}
    for d, start, n, crc in got:
        assert start == at
        at += n
        by.setdefault(d, []).append((n, crc))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    want = {}
    for d, text in rows:
        ids = whole(text) + [0]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    assert {d: sorted(v) for d, v in by.items()} == {d: sorted(v) for d, v in want.items()}
    assert T.token_table(documents(spark, [])).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 1000, 60_000):
        keys = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        sizes, bits = T.build_hash(keys)
        assert sorted(T.find_slots(keys, sizes, bits).tolist()) == list(range(len(keys)))


def test_keys_that_share_a_value_are_told_apart():
    keys = np.stack([np.arange(5000) // 50, np.arange(5000) % 50], axis=1).astype(np.uint64)
    sizes, bits = T.build_hash(keys)
    assert sorted(T.find_slots(keys, sizes, bits).tolist()) == list(range(5000))


def test_shards_follow_the_size_of_the_corpus():
    assert T.shard_count(0, 200) == 1 and T.shard_count(10 << 20, 200) == 3
    assert T.shard_count(1 << 30, 8) == 8 and T.shard_count(1 << 40, 8) == 2048


def test_cluster_paths_are_understood():
    assert T.file_system("file:/tmp/x")[1] == "/tmp/x"


def test_unknown_keys_are_not_found(spark):
    path = T.scratch_path(spark, "test-shards")
    manifest = T.write_shards(documents(spark, [(i, f"text {i}") for i in range(500)]), path)
    index, buckets = T.build_index(manifest, bucket_keys=100)
    assert buckets == 5 and index.count() == 5
    keys = spark.createDataFrame([(i, 0) for i in range(400, 600)] + [(1, 1), (None, 0)], "doc_id long, number long")
    assert {r["doc_id"] for r in T.look_up(keys, index, buckets).collect()} == set(range(400, 500))
