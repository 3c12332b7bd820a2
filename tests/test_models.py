import math

from pyspark.sql import functions as F

from textlens.operators import classify as CL
from textlens.operators import vectors as VX


def test_split_exact_size(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "row_id")
    s = CL.split_train_test(df, 0.3, 30)
    assert s.filter(F.col("split") == "test").count() == math.ceil(0.3 * 1001)


def test_stratified_folds_match_allocation(spark):
    labels = [0] * 23 + [1] * 9
    rows = [(i, labels[(i * 7) % 32]) for i in range(32)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    got = {r["row_id"]: r["fold"] for r in CL.stratified_folds(df, "label", 5).collect()}
    # brute force of the sorted-label allocation
    y = [lab for _, lab in sorted(rows)]
    order = sorted(y)
    expect = {}
    for k in (0, 1):
        alloc = [sum(1 for j in range(f, len(order), 5) if order[j] == k) for f in range(5)]
        folds = [f for f in range(5) for _ in range(alloc[f])]
        ids = [i for i, lab in sorted(rows) if lab == k]
        expect.update(dict(zip(ids, folds)))
    assert got == expect


def test_roc_auc_brute_force(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.5), (0, 0.1), (0, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    auc = CL.roc_auc(df).first()[0]
    pos = [s for lab, s in rows if lab == 1]
    neg = [s for lab, s in rows if lab == 0]
    bf = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - bf) < 1e-12


def test_doc_mean_in_vocabulary_only(spark):
    vec = spark.createDataFrame([("a", [1.0, 3.0])], "word string, vector array<double>")
    docs = spark.createDataFrame([(1, ["a", "zz"]), (2, ["zz"])], "row_id long, toks array<string>")
    got = {r["row_id"]: r["features"] for r in VX.doc_mean_vector(docs, "toks", vec, 2).collect()}
    assert got == {1: [1.0, 3.0], 2: [0.0, 0.0]}


def test_doc_means_by_groups(spark, monkeypatch):
    """Documents of many groups, keys and words that come twice, keys and texts
    that are null: the same means; no vector travels for each token."""
    import numpy as np
    from pyspark.sql import functions as F
    monkeypatch.setattr(VX, "GROUP_TOKENS", 40)
    monkeypatch.setattr(VX, "SLICE", 7)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    vec = [(w, [float(x) for x in rng.normal(size=3)]) for w in words[:20]] + [("w3", [1.0, 2.0, 3.0]), (None, [9.0, 9.0, 9.0])]
    docs = [(i // 2 if i < 20 else i, [str(w) for w in rng.choice(words, rng.integers(0, 40))]) for i in range(60)]
    docs += [(None, ["w1"]), (None, None), (777, None), (778, ["w25", None]), (779, ["w2"] * 50)]
    v = spark.createDataFrame(vec, "word string, vector array<float>")
    df = spark.createDataFrame(docs, "row_id long, toks array<string>").repartition(4)
    found = VX.doc_mean_vector(df, "toks", v, 3)
    want = []
    for key, _ in docs:
        mine = [np.float32(x) for k, toks in docs if k is not None and k == key for t in toks or [] if t for w, x in vec if w == t]
        want.append((-1 if key is None else key, len(mine), *np.round(np.mean(mine, axis=0, dtype=float) if mine else np.zeros(3), 5)))
    got = [(-1 if r[0] is None else r[0], r[1], *np.round(r[2], 5)) for r in found.collect()]
    assert sorted(got) == sorted(want)
    # vectors are dealt by word and group: no step explodes tokens beside their vectors
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Summarizer" not in plan
    assert found.select(F.sum("n_known")).first()[0] == sum(w[1] for w in want)


def test_roc_curve_drops_collinear_points(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 40, size=300).astype(float)
    labels = (rng.random(300) < 0.4).astype(int)
    df = spark.createDataFrame([(int(l), float(s)) for l, s in zip(labels, scores)], "label int, score double")
    got = [(r["threshold"], round(r["fpr"], 12), round(r["tpr"], 12)) for r in CL.roc_curve(df).orderBy("fpr", "tpr", F.desc("threshold")).collect()]
    # brute force of the drop-intermediate rule
    th = sorted(set(scores), reverse=True)
    fps = np.array([sum(1 for s, l in zip(scores, labels) if s >= t and l == 0) for t in th])
    tps = np.array([sum(1 for s, l in zip(scores, labels) if s >= t and l == 1) for t in th])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    exp = [(float("inf"), 0.0, 0.0)] + [(th[i], round(fps[i] / fps[-1], 12), round(tps[i] / tps[-1], 12)) for i in keep]
    exp = sorted(exp, key=lambda x: (x[1], x[2], -x[0]))
    assert got == exp


def test_bucketed_ranks_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(CL, "BUCKET_ROWS", 7)
    df = spark.createDataFrame([(i, (i * 37) % 101 % 50) for i in range(101)], "row_id long, v int")
    b = CL.with_quantile_bucket(df, "v")
    assert b.select("_b").distinct().count() > 8
    got = [(r["v"], r["rank"]) for r in CL.bucketed_rank(b, F.col("_b"), ["v", "row_id"]).collect()]
    assert sorted(r for _, r in got) == list(range(1, 102))
    assert [v for v, _ in sorted(got, key=lambda x: x[1])] == sorted(v for v, _ in got)


def test_streaming_reads_a_folder_of_part_files(spark, tmp_path):
    from textlens.streaming.clean_stream import clean_stream, run_to_parquet
    rows = [(i, f"Text {i} http://x.y", "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert spark.read.parquet(run_to_parquet(clean_stream(spark, str(tmp_path)))).count() == 30
