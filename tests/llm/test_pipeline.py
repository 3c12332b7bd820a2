"""The pipeline's stages on a small table, each held against a plain version."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from textlens.llm import bpe, mixing

from .helpers import prose
from .test_ngram_join import brute as groups_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: clean texts, junk, copies, near copies, leaks, odd rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    leak = " ".join(prose(77, 30, 10 ** 6).split())
    rows = [(i, prose(i, 60, 5000)) for i in range(200)]
    rows += [(200 + i, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400 + i, rows[i][1] + " more") for i in range(10)]
    rows += [(500 + i, prose(900 + i, 40, 5000) + " " + leak.upper() + " " + prose(950 + i, 20, 5000)) for i in range(10)]
    rows += [(600, None), (601, ""), (602, "few words"), (0, rows[0][1])]
    docs = [(d, t, "en", f"s{(d or 0) % 4}" if (d or 0) % 9 else None, 0) for d, t in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        step[name] = (before, docs)
        if name != "token_index":
            assert docs.columns == before.columns

    def ids(frame):
        return Counter(r["doc_id"] for r in frame.collect())

    before, after = map(ids, step["quality_rules"])
    assert after == Counter({d: n for d, n in before.items() if not (200 <= d < 260 or d >= 600)})

    before, after = step["ngram_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.dropDuplicates(["doc_id"]).collect()]
    first = {d for d, (_, c) in groups_of(rows).items() if d == c}
    assert set(ids(after)) == first and not any(300 <= d < 500 for d in first)

    before, after = map(ids, step["decontaminate"])
    assert after == Counter({d: n for d, n in before.items() if not 500 <= d < 600})

    before, after = step["mixing"]
    size = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in before.collect()}
    total = Counter()
    for r in before.collect():
        total[r["source"]] += size[r["doc_id"]][1]
    got = Counter()
    for d, n in ids(after).items():
        got[size[d][0]] += n * size[d][1]
        assert n <= 3 * ids(before)[d]
    for s, target in mixing.source_targets(dict(total)).items():
        assert abs(got[s] - target) <= 130, s

    before, after = step["token_index"]
    tok = bpe.encoder(bpe.vocabulary_path()).tokenizer
    want = sorted((r["doc_id"], tok.encode(r["text"], add_special_tokens=False).ids + [0]) for r in before.collect())
    at, expected = 0, []
    for d, found in want:
        expected.append((d, at, len(found), zlib.crc32(np.asarray(found, "<u4").tobytes())))
        at += len(found)
    assert sorted(map(tuple, after.collect())) == sorted(expected)


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "decontaminate", "mixing", "token_index"]


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_entry_registers_each_operator():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
