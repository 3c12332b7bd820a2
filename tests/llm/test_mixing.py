from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from textlens.llm import mixing as M

from .helpers import DOCS, ODD, prose


def table(spark, sizes):
    rows, i = [], 0
    for source, texts in sizes.items():
        for t in texts:
            rows.append((i, t, "en", source, 0, "x"))
            i += 1
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def docs(spark):
    return table(spark, {"b": [prose(i, 5 + i % 90) for i in range(300)], "a": [prose(i, 40) for i in range(20)], None: [prose(i, 30) for i in range(50)],
                         "é": [prose(i, 25) for i in range(60)], "z": [None, "", " "], "odd": ODD[3:6]})


def test_targets_share_the_excess():
    assert M.source_targets({"a": 100, "b": 100, "c": 100}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    got = M.source_targets({"a": 10, "b": 1000, None: 0})
    assert got == {"a": 30.0, "b": 980.0, None: 0.0}
    sizes = {f"s{i:02}": (i * 37) % 91 + 1 for i in range(20)}
    got = M.source_targets(sizes)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 and all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    level = [got[s] / M.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes)) if got[s] < 3 * sizes[s] - 1e-9]
    assert max(level) - min(level) < 1e-9


def test_split_tree_is_exact_and_unbiased():
    quota, room = np.asarray([50, 7, 0, 143]), np.asarray([40] * 5)
    rows = [M.split_tree(quota, room, seed) for seed in range(300)]
    for r in rows:
        assert (r.sum(0) == quota).all() and (r.sum(1) == room).all() and (r >= 0).all()
    mean = np.mean(rows, 0)
    assert np.abs(mean - quota / 5).max() < 0.8
    # each shard's count of a source is hypergeometric: compare the variance
    share = 50 / 200
    assert abs(np.var([r[0, 0] for r in rows]) / (40 * share * (1 - share) * 160 / 199) - 1) < 0.4


def check(docs, sizes_of):
    got = M.taken(M.plan_mix(docs)).collect()
    per = defaultdict(int)
    for r in got:
        s = sizes_of[r["doc_id"]]
        per[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["target"] <= 3 * r["source_size"] + 1e-9
    for r in got:
        assert abs(per[sizes_of[r["doc_id"]]] - r["target"]) <= 50
    return {r["doc_id"]: r["taken"] for r in got}


def test_taken_is_near_targets_and_reruns_agree(spark, docs, monkeypatch):
    source = {r["doc_id"]: r["source"] for r in docs.where("source is null or source <> 'odd'").collect()}
    docs = docs.where("source is null or source <> 'odd'")
    first = check(docs, source)
    assert check(docs.repartition(7), source) == first
    monkeypatch.setattr(M, "BLOCK_WORDS", 100)
    check(docs, source)


def test_mixed_rows_are_what_is_taken(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 200)
    out = M.mixed(docs, shards=4)
    assert out.schema == docs.schema and out.rdd.getNumPartitions() == 4
    times = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in M.taken(M.plan_mix(docs, shards=4)).collect():
        if r["size"]:
            assert times.get(r["doc_id"], 0) * r["size"] == r["taken"]


def test_empty_and_repeated_rows(spark, docs):
    assert M.taken(M.plan_mix(docs.limit(0))).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    twice = docs.where("source = 'a'").unionByName(docs.where("source = 'a'"))
    got = M.taken(M.plan_mix(twice)).collect()
    assert len(got) == 40 and {r["target"] for r in got} == {1600.0}
    assert all(len({x["taken"] for x in got if x["doc_id"] == i}) == 1 for i in {r["doc_id"] for r in got})


def test_rows_without_words_are_not_gathered(spark, monkeypatch):
    import re
    plans, write = [], M.written

    def watched(df, name):
        if name == "chosen":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(M, "written", watched)
    docs = spark.createDataFrame([(i, "a b c" if i % 3 else "", "s") for i in range(60)], "doc_id long, text string, source string")
    rows = M.taken(M.plan_mix(docs)).collect()
    assert len(rows) == 60 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert re.search(r"size#\d+L? > 0", plans[0])


def test_shards_follow_the_words(docs, monkeypatch):
    assert M.plan_mix(docs).shards == M.LEAST_SHARDS
    monkeypatch.setattr(M, "SHARD_WORDS", 100)
    monkeypatch.setattr(M, "BLOCKS", 2)  # fewer blocks than sources: the draws are joined without a broadcast
    mix = M.plan_mix(docs)
    words = docs.select(F.sum(M.size_of(F.col("text")))).first()[0]
    assert mix.shards == -(-words // 100) > M.LEAST_SHARDS and not mix.few
    assert sum(r["taken"] for r in M.taken(mix).collect()) > 0.9 * words
