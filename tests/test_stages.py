"""Stages and pipelines are stored, loaded again and score other posts equally."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from textlens.operators import classify as CL
from textlens.operators import topic_models as M
from textlens.operators import topics as TP
from textlens.operators import vectors as VX


def posts(spark, n=60):
    good, bad = "train fast clean seat", "train late broken delay"
    rows = [(i, float(i % 2), f"{bad if i % 2 else good} word{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label double, text string")


def test_scoring_pipeline_is_stored(spark, tmp_path):
    words = ["train", "fast", "clean", "seat", "late", "broken", "delay"]
    vectors = spark.createDataFrame([(w, [float(i == j) for j in range(len(words))]) for i, w in enumerate(words)], "word string, vector array<double>")
    stages = [VX.CleanTokenizer("text", "toks"), VX.MeanEmbedding(vectors, len(words), inputCol="toks", outputCol="features"), CL.rf(trees=3, depth=2)]
    model = Pipeline(stages=stages).fit(posts(spark))
    model.write().save(f"{tmp_path}/p")
    back = PipelineModel.load(f"{tmp_path}/p")
    other = spark.createDataFrame([(1, "A clean seat"), (2, "broken AND late"), (3, None), (4, "unknown words")], "row_id long, text string")
    a, b = ({r["row_id"]: r["prediction"] for r in m.transform(other).collect()} for m in (model, back))
    assert a == b and (a[1], a[2]) == (0.0, 1.0) and set(a) == {1, 2, 3, 4}


def test_topic_pipeline_is_stored(spark, tmp_path):
    rows = [(i, (["new", "york", "taxi", "street"] if i % 2 else ["green", "apple", "tree", "leaf"]) * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, toks array<string>")
    phrases = spark.createDataFrame([("new", "york"), ("green", "apple")], "a string, b string")
    merged = TP.phrase_apply(df, "toks", phrases)
    dictionary = TP.dictionary_filter(TP.dictionary_build(merged, "toks"), 40, 1, 1.0).select("id", "term").cache()
    assert {"new_york", "green_apple"} <= {r["term"] for r in dictionary.collect()}
    s = M.Setting(2, "asymmetric", 0.5, 10, 20, 4)
    model = M.TopicModel.of(M.fit(M.bags_of(merged, "toks", dictionary), [s], dictionary.count()), 0, s, dictionary)
    pipeline = PipelineModel([VX.CleanTokenizer("text", "toks"), VX.PhraseMerger(phrases), VX.TopicShares(model, spark)])
    pipeline.write().save(f"{tmp_path}/t")
    back = PipelineModel.load(f"{tmp_path}/t")
    other = spark.createDataFrame([(1, "a taxi in New York street"), (2, "Green apple leaf"), (3, None)], "row_id long, text string")
    a, b = ({r["row_id"]: r["shares"] for r in p.transform(other).collect()} for p in (pipeline, back))
    assert a == b and all(abs(sum(x) - 1) < 1e-9 for x in a.values())
    best = {i: max(range(2), key=lambda t: x[t]) for i, x in a.items()}
    assert best[1] != best[2]
    want = model.infer(M.bags_of(TP.phrase_apply(VX.CleanTokenizer("text", "toks").transform(other), "toks", phrases), "toks", dictionary))
    assert {r["row_id"]: r["shares"] for r in want.collect()} == a


def test_stage_parameters_survive(spark, tmp_path):
    stage = VX.CleanTokenizer("body", "words")
    stage.write().save(f"{tmp_path}/c")
    back = VX.CleanTokenizer.load(f"{tmp_path}/c")
    assert (back.getInputCol(), back.getOutputCol(), back.uid) == ("body", "words", stage.uid)
    df = spark.createDataFrame([(1, "x")], "row_id long, body string")
    assert back.transform(df).select(F.size("words")).first()[0] == 1


def test_a_mean_embedding_keeps_one_copy_of_its_rows(spark):
    """Rows that are cut off already are not copied again, and a copy that was made for the stage goes."""
    from pathlib import Path

    from textlens.session import cut_lineage, ensure_checkpoint_dir
    at = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    vectors = spark.createDataFrame([("train", [1.0, 0.0]), ("late", [0.0, 1.0])], "word string, vector array<double>")
    df = spark.createDataFrame([(1, ["train", "late"]), (2, ["late", "x"]), (3, None)], "row_id long, toks array<string>")
    want = {1: [0.5, 0.5], 2: [0.0, 1.0], 3: [0.0, 0.0]}
    for rows in (df, cut_lineage(df)):
        before = {p.name for p in at.iterdir()}
        out = VX.MeanEmbedding(vectors, 2, inputCol="toks", outputCol="features").transform(rows)
        assert len({p.name for p in at.iterdir()} - before) == 1
        assert {r["row_id"]: list(r["features"]) for r in out.collect()} == want and rows.count() == 3
