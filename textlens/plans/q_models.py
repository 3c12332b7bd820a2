"""Queries for features, splits, classifiers and evaluation,
plus lexicon word lists (2.7) and the best-parameter pick (2.5).

Event rows: labelled posts, positive sentiment dropped, target 'yes';
sentiment encoded alphabetically (negative 0, neutral 1).  Features are the
mean stand-in word vectors of each post.  Metric operators are checked on a
fixed score (post length against the ``toxic`` label).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import classify as CL
from ..operators import kernel_svm as SV
from ..operators import relational as R
from ..operators import trees as TR
from ..operators import vectors as VX
from ..sources import files as FS
from ..sources import tables as TB
from ..session import cut_lineage, scratch_path
from . import oracle as O
from .catalog import register
from .q_vectors import DIM, corpus, vectors

R6 = 6
SEED = L.SEEDS["split_en"]

EVENT_SQL = ("ev AS (SELECT row_id, sentiment, CAST(dense_rank() OVER (ORDER BY sentiment) - 1 AS INTEGER) AS label "
             "FROM labelled WHERE sentiment IS DISTINCT FROM 'positive' AND target = 'yes')")
SPLIT_SQL = (f"sp AS (SELECT row_id, label, CASE WHEN row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || ':{SEED}'), row_id) "
             f"<= ceil(0.3 * (SELECT count(*) FROM ev)) THEN 'test' ELSE 'train' END AS split FROM ev)")


def W(body, *ctes):
    return "WITH " + ", ".join([f"labelled AS ({TB.SQL_VIEWS['labelled']})", *ctes]) + " " + body


def events(spark, sf):
    lab = TB.labelled(spark, sf)
    ev = R.filter_event_rows(R.filter_not_label(lab, "sentiment", "positive"), "target", "yes")
    return CL.label_encode(ev.select("row_id", "sentiment"), "sentiment", "label")


# ---------------------------------------------------------------- labels --

@register("label_encode", W("SELECT row_id, sentiment, label FROM ev", EVENT_SQL))
def label_encode(spark, sf):
    return events(spark, sf)


@register("split_train_test", W("SELECT row_id, split FROM sp", EVENT_SQL, SPLIT_SQL))
def split_train_test(spark, sf):
    return CL.split_train_test(events(spark, sf), 0.3, SEED).select("row_id", "split")


@register("class_counts", W("SELECT split, label, count(*) AS n FROM sp GROUP BY 1, 2", EVENT_SQL, SPLIT_SQL))
def class_counts(spark, sf):
    return R.class_counts(CL.split_train_test(events(spark, sf), 0.3, SEED), "split", "label")


@register("class_weights", W(
    f"SELECT label, count(*) AS n, round((SELECT count(*) FROM ev) / ((SELECT count(DISTINCT label) FROM ev) * count(*)), {R6}) "
    "AS weight FROM ev GROUP BY label", EVENT_SQL))
def class_weights(spark, sf):
    w = CL.class_weights(events(spark, sf), "label")
    return w.select("label", "n", F.round("weight", R6).alias("weight"))


@register("stratified_folds", W(
    "SELECT e.row_id, e.label, a.fold FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS r FROM ev) e "
    "JOIN (SELECT label, fold, sum(sz) OVER (PARTITION BY label ORDER BY fold) - sz AS lo, sum(sz) OVER (PARTITION BY label ORDER BY fold) AS hi FROM ("
    "SELECT c.label, f.fold, CASE WHEN c.s + ((f.fold - c.s) % 10 + 10) % 10 < c.s + c.n "
    "THEN (c.s + c.n - 1 - (c.s + ((f.fold - c.s) % 10 + 10) % 10)) // 10 + 1 ELSE 0 END AS sz FROM "
    "(SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) - count(*) AS s FROM ev GROUP BY label) c, "
    "(SELECT CAST(range AS INTEGER) AS fold FROM range(10)) f)) a ON e.label = a.label AND e.r >= a.lo AND e.r < a.hi",
    EVENT_SQL))
def stratified_folds(spark, sf):
    return CL.stratified_folds(events(spark, sf).select("row_id", "label"), "label", 10)


@register("join_rows_by_id", W(
    "SELECT sp.row_id, sp.split, CAST(len(ct.toks) AS BIGINT) AS n_tokens FROM sp JOIN ct USING (row_id)",
    EVENT_SQL, SPLIT_SQL, f"ct AS (SELECT row_id, {O.words('text')} AS toks FROM labelled)"))
def join_rows_by_id(spark, sf):
    from ..functions import tokens as K
    feats = TB.labelled(spark, sf, text_work=True).select("row_id", F.size(K.tok_words("text")).cast("long").alias("n_tokens"))
    split = CL.split_train_test(events(spark, sf), 0.3, SEED).select("row_id", "split")
    return R.join_rows_by_id(feats, split)


# ------------------------------------------------------------- features --

@register("count_terms", W(
    "SELECT row_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms FROM "
    "(SELECT row_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}', 0) AS w FROM labelled)"))
def count_terms(spark, sf):
    words = CL.words_of(F.col("text"))
    lab = TB.labelled(spark, sf, text_work=True).select("row_id", words.alias("w"))
    return lab.select("row_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@register("tfidf", W(
    "SELECT row_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)), 6) AS weight FROM ("
    "SELECT t.row_id, t.term, t.tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + d.df)) + 1) AS raw FROM "
    "(SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM docs) GROUP BY 1, 2) t JOIN "
    "(SELECT term, count(DISTINCT row_id) AS df FROM (SELECT row_id, unnest(w) AS term FROM docs) GROUP BY 1) d USING (term))",
    EVENT_SQL, "docs AS (SELECT l.row_id, regexp_extract_all(lower(l.text), '[\\p{L}\\p{N}_]{2,}', 0) AS w "
    "FROM labelled l JOIN ev USING (row_id))"))
def tfidf(spark, sf):
    lab = TB.labelled(spark, sf, text_work=True).join(events(spark, sf).select("row_id"), "row_id")
    d = lab.select("row_id", CL.words_of(F.col("text")).alias("w"))
    t = CL.tfidf(d, "w")
    return t.select("row_id", "term", F.round("weight", R6).alias("weight"))


# ------------------------------------------------- metrics on a fixed score --

SCORED_SQL = ("sc AS (SELECT d.doc_id AS row_id, l.toxic AS label, CASE WHEN d.n_chars >= 2400 THEN 1 ELSE 0 END AS prediction, "
              "CAST(d.n_chars AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id))")


def scored(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = TB.table(spark, sf, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id")
    return j.select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"),
                    F.when(F.col("n_chars") >= 2400, 1).otherwise(0).alias("prediction"),
                    F.col("n_chars").cast("double").alias("score"))


@register("accuracy", "WITH " + SCORED_SQL + f" SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), {R6}) AS accuracy FROM sc")
def accuracy(spark, sf):
    return CL.accuracy(scored(spark, sf)).select(F.round("accuracy", R6).alias("accuracy"))


@register("classification_report", "WITH " + SCORED_SQL + ", per AS (SELECT CAST(c AS VARCHAR) AS class, "
          "CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS recall, sup AS support FROM ("
          "SELECT c, (SELECT count(*) FROM sc WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM sc WHERE label = c) AS sup, "
          "(SELECT count(*) FROM sc WHERE prediction = c) AS np FROM (SELECT DISTINCT label AS c FROM sc UNION SELECT DISTINCT prediction FROM sc))), "
          "per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per), "
          "allr AS (SELECT class, precision, recall, f1, support FROM per2 UNION ALL "
          "SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per2 UNION ALL "
          "SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
          "sum(f1 * support) / sum(support), sum(support) FROM per2) "
          f"SELECT class, round(precision, {R6}) AS precision, round(recall, {R6}) AS recall, round(f1, {R6}) AS f1, "
          "CAST(support AS BIGINT) AS support FROM allr")
def classification_report(spark, sf):
    r = CL.classification_report(scored(spark, sf))
    return r.select("class", *[F.round(c, R6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("confusion_matrix", "WITH " + SCORED_SQL + " SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, "
          "count(*) FILTER (WHERE prediction = 1) AS pred_1 FROM sc GROUP BY label")
def confusion_matrix(spark, sf):
    return CL.confusion_matrix(scored(spark, sf), [0, 1])


@register("roc_curve", "WITH " + SCORED_SQL + ", g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY score), "
          "t AS (SELECT sum(label) AS P, sum(1 - label) AS N FROM sc), "
          "c AS (SELECT score, pos, neg, sum(neg) OVER w AS cn, sum(pos) OVER w AS cp, lead(pos) OVER w2 AS npos, "
          "lead(neg) OVER w2 AS nneg, row_number() OVER w2 AS rn FROM g "
          "WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (ORDER BY score DESC)) "
          f"SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL "
          f"SELECT score, round(cn / t.N, {R6}), round(cp / t.P, {R6}) FROM c, t "
          "WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg")
def roc_curve(spark, sf):
    c = CL.roc_curve(scored(spark, sf))
    return c.select("threshold", F.round("fpr", R6).alias("fpr"), F.round("tpr", R6).alias("tpr"))


@register("roc_auc", "WITH " + SCORED_SQL + ", g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY score) "
          f"SELECT round((sum(pos * (cn - neg)) + 0.5 * sum(pos * neg)) / (sum(pos) * sum(neg)), {R6}) AS auc FROM "
          "(SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM g)")
def roc_auc(spark, sf):
    return CL.roc_auc(scored(spark, sf)).select(F.round("auc", R6).alias("auc"))


@register("score_summary_box", (
    "SELECT lang, " + ", ".join(f"round(quantile_cont(CAST(n_chars AS DOUBLE), {q}), {R6}) AS {n}" for q, n in
                                 [(0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max")])
    + " FROM documents WHERE lang IS NOT NULL GROUP BY lang"))
def score_summary_box(spark, sf):
    d = TB.table(spark, sf, "documents").filter(F.col("lang").isNotNull()).select("lang", F.col("n_chars").cast("double").alias("s"))
    s = CL.score_summary(d, "lang", "s")
    return s.select("lang", *[F.round(c, R6).alias(c) for c in ("min", "q1", "median", "q3", "max")])


# -------------------------------------------------------- lexicon words --

@register("lex_keep_words", (
    "SELECT DISTINCT word, kind FROM (SELECT unnest(string_split(source, ' ')) AS word, 'special' AS kind FROM "
    "(SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) UNION ALL "
    "SELECT unnest(string_split(val, ' ')), 'standard' FROM (SELECT arg_max(lang, doc_id) AS val FROM documents "
    "WHERE source IS NOT NULL GROUP BY source) UNION ALL "
    "SELECT unnest(string_split(source, ' ')), 'standard' FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) "
    "WHERE word <> ''"))
def lex_keep_words(spark, sf):
    """Special words (words of the station lexicon) and standard words
    (words of the replacement values plus the special words), from lexicon
    files derived from the tables: sources as the list lexicon, ``source,
    lang`` lines as the map lexicon."""
    pl = scratch_path(spark, "lk_list")
    pp = scratch_path(spark, "lk_pairs")
    d = TB.table(spark, sf, "documents").dropna(subset=["source"])
    FS.write_list_lexicon(d, "source", pl)
    FS.write_lines_in_order(d.select("doc_id", F.concat_ws(", ", "source", "lang").alias("line")), "line", "doc_id", pp, 4)
    stations = FS.read_list_lexicon(spark, pl).select(F.col("term"))
    pairs = FS.read_pair_lexicon(spark, pp)
    words = lambda df, c: df.select(F.explode(F.split(c, " ")).alias("word")).filter(F.col("word") != "")
    special = words(stations, F.col("term")).withColumn("kind", F.lit("special"))
    standard = words(pairs, F.col("val")).unionByName(words(stations, F.col("term"))).withColumn("kind", F.lit("standard"))
    return special.unionByName(standard).distinct()


# ---------------------------------------------------------- classifiers --

def features(spark, sf):
    """(row_id, label, features VECTOR, split) for the event rows."""
    ev = events(spark, sf)
    posts = corpus(spark, sf)
    c = cut_lineage(posts.join(ev.select("row_id"), "row_id"))
    m = VX.doc_mean_vector(c, "toks", vectors(spark, sf, posts), DIM)
    j = ev.join(m, "row_id").withColumn("label", F.col("label").cast("double"))
    j = CL.as_vector(j, "features")
    return CL.split_train_test(j, 0.3, SEED).cache()


def _eval(pred):
    return pred.select("row_id", "label", "prediction")


def _weighted_train(d):
    return CL.with_weights(d.filter(F.col("split") == "train"), "label", "weight")


@register("rf_fit")
def rf_fit(spark, sf):
    d = features(spark, sf)
    model = CL.rf(trees=10, depth=5, weight_col="weight").fit(_weighted_train(d))
    return _eval(model.transform(d.filter(F.col("split") == "test")))


@register("predict")
def predict(spark, sf):
    """Each classifier fitted on the training rows, stored, loaded again and
    applied to the test rows."""
    from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
    d = features(spark, sf)
    te = d.filter(F.col("split") == "test")
    fits = [("RF", CL.rf(trees=10, depth=5, weight_col="weight").fit(_weighted_train(d)), RandomForestClassificationModel),
            ("GBT", CL.gbt().fit(d.filter(F.col("split") == "train")), GBTClassificationModel)]
    kernels = [SV.Kernel("rbf", SVM_GAMMA)]
    tr, arrays = _svm_split(d)
    _, _, found, marks = _machines(tr, kernels, 0)
    p = scratch_path(spark, "model_SVM")
    SV.save(p, tr, kernels, marks, found[SVM_COST])
    out = (_apply(arrays, *SV.load(spark, p))
           .select(F.lit("SVM").alias("model"), "row_id", "label", (F.col("margin") > 0).cast("double").alias("prediction")))
    for name, model, kind in fits:
        p = scratch_path(spark, f"model_{name}")
        FS.save_model(model, p)
        got = _eval(FS.load_model(kind, p).transform(te)).select(F.lit(name).alias("model"), "row_id", "label", "prediction")
        out = out.unionByName(got)
    return out


@register("predict_proba")
def predict_proba(spark, sf):
    d = features(spark, sf)
    model = CL.rf(trees=10, depth=5, weight_col="weight").fit(_weighted_train(d))
    p = model.transform(d.filter(F.col("split") == "test"))
    return p.select("row_id", CL.prob1().alias("p1"))


def _points(settings):
    """The points of a grid."""
    from itertools import product
    return [dict(zip(settings, p)) for p in product(*settings.values())]


def _bins(d, keep):
    """Rows ``keep`` with their binned features, bounds taken from ``d``."""
    from pyspark.ml.functions import vector_to_array
    d = d.withColumn("_x", vector_to_array("features"))
    bounds = TR.boundaries(d, "_x")
    return cut_lineage(TR.binned(d, "_x", bounds, keep)), len(bounds)


def _fold_bins(d, folds):
    """The binned rows with their stratified fold."""
    return _bins(CL.stratified_folds(d.drop("split"), "label", folds), ["row_id", "label", "fold"])


@register("rf_grid")
def rf_grid(spark, sf, grid=L.RF_GRID_EN, folds=L.RF_GRID_FOLDS):
    """The forest grid over stratified folds with balanced weights: a row for
    each of the 4,200 parameter sets with its mean accuracy.

    Forests are dealt over tasks, or beyond a bound all trees grow together, a
    job per level.  Grown are the trees of the largest forest, at the largest depth and the smallest split size, for each
    feature rule, criterion, leaf size and fold; all other sets are the first
    trees of these forests, or the same trees cut.  "auto" features are "sqrt"."""
    tr, n_features = _fold_bins(features(spark, sf).filter(F.col("split") == "train"), folds)
    return _rf_scores(tr, n_features, grid, folds)


def _rf_scores(tr, n_features, grid, folds):
    from itertools import product
    spark = tr.sparkSession
    weights = TR.balanced(tr, folds)
    rules = list(dict.fromkeys("sqrt" if r == "auto" else r for r in grid["features"]))
    kinds = list(product(rules, grid["criterion"], grid["leaf"], range(folds)))
    forests = [TR.forest(tr, max(grid["trees"]), weights[f], n_features, rule, criterion, max(grid["depth"]), leaf, f, L.SEEDS["boosted"])
               for rule, criterion, leaf, f in kinds]
    scores = TR.forest_grid(tr, forests, grid["trees"], grid["depth"], grid["split"])
    names = spark.createDataFrame([(i, rule, c, leaf) for i, (rule, c, leaf, _) in enumerate(kinds)], "grp int, rule string, criterion string, leaf int")
    mean = (scores.join(names, "grp").groupBy("trees", "rule", "criterion", "depth", "split", "leaf")
            .agg(F.avg(F.col("correct") / F.col("n")).alias("mean_score")))
    points = [(p["trees"], "sqrt" if p["features"] == "auto" else p["features"], p["criterion"], p["depth"], p["split"], p["leaf"],
               json.dumps(p, sort_keys=True)) for p in _points(grid)]
    points = spark.createDataFrame(points, "trees int, rule string, criterion string, depth int, split int, leaf int, params string")
    return (points.join(mean, ["trees", "rule", "criterion", "depth", "split", "leaf"])
            .select(F.lit("RF").alias("model"), "params", "mean_score"))


#: The pick of the best parameters, over a table ``grid`` (the operator's SQL form).
BEST_SQL = ("SELECT model, params, mean_score FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_score DESC, params DESC) "
            "AS place FROM grid) WHERE place = 1")


def best_of(grid):
    """Per model the best-scored parameters, of equal ones the last by name."""
    return grid.groupBy("model").agg(F.max_by("params", F.struct("mean_score", "params")).alias("params"),
                                     F.max("mean_score").alias("mean_score"))


@register("best_params")
def best_params(spark, sf):
    return best_of(rf_grid(spark, sf))


@register("gbt_fit")
def gbt_fit(spark, sf):
    d = features(spark, sf)
    model = CL.gbt().fit(d.filter(F.col("split") == "train"))
    return _eval(model.transform(d.filter(F.col("split") == "test")))


@register("gbt_grid")
def gbt_grid(spark, sf, grid=L.GBT_GRID, folds=L.CV_FOLDS):
    """The boosted grid over ten stratified folds: 96 rows.  One model of the
    most trees is fitted per depth, rate and fold; its running sums answer the
    smaller numbers of trees."""
    tr, _ = _fold_bins(features(spark, sf).filter(F.col("split") == "train"), folds)
    return _gbt_scores(tr, grid, folds)


def _gbt_scores(tr, grid, folds):
    from itertools import product
    spark = tr.sparkSession
    kinds = sorted(product(grid["depth"], grid["rate"], range(folds)), reverse=True)
    scores = TR.boosted_scores(tr, [TR.Boosted(*k) for k in kinds], grid["trees"])
    names = spark.createDataFrame([(i, d, float(r)) for i, (d, r, _) in enumerate(kinds)], "model int, depth int, rate double")
    mean = scores.join(names, "model").groupBy("depth", "trees", "rate").agg(F.avg(F.col("correct") / F.col("n")).alias("mean_score"))
    points = spark.createDataFrame([(p["depth"], p["trees"], float(p["rate"]), json.dumps(p, sort_keys=True)) for p in _points(grid)],
                                   "depth int, trees int, rate double, params string")
    return points.join(mean, ["depth", "trees", "rate"]).select(F.lit("GBT").alias("model"), "params", "mean_score")


#: The cost of the machines that are fitted outside the grid.
SVM_COST = L.SVM_GRID["C"][0]
SVM_GAMMA = 0.1


def _svm_folds(d, folds):
    """(row_id, label, fold, x): rows with their stratified fold and their
    features as an array."""
    from pyspark.ml.functions import vector_to_array
    d = CL.stratified_folds(d.drop("split"), "label", folds)
    return cut_lineage(d.select("row_id", "label", "fold", vector_to_array("features").alias("x")))


def _kernels(grid=None):
    """The kernels of a grid; gamma is no setting of the linear one."""
    kinds = [(k, g) for k in (grid or L.SVM_GRID)["kernel"] for g in ([1.0] if k == "linear" else (grid or L.SVM_GRID)["gamma"])]
    return [SV.Kernel(k, g) for k, g in kinds]


def _machines(d, kernels, folds, costs=(SVM_COST,)):
    """Blocks of the mapped rows of ``d`` and, per cost, the weights of all
    machines: one per kernel and held-out fold, and one (-1) of all rows."""
    marks = SV.landmarks(d, "x")
    held, parts = SV.blocks(d, "x", kernels, marks)
    names = [-1, *range(folds)]
    return held, names, SV.fit(held, parts, names, costs), marks


def _apply(rows, kernels, marks, weights):
    """(map, row_id, label, margin) of other rows by the machines of all rows."""
    fresh, _ = SV.blocks(rows.withColumn("fold", F.lit(-1)), "x", kernels, marks)
    return SV.margins(fresh, {m: w[:1] for m, w in weights.items()}, [-1], "all")


def _svm_split(d):
    """Training rows with ten folds, and test rows, features as arrays."""
    from pyspark.ml.functions import vector_to_array
    te = d.filter(F.col("split") == "test").select("row_id", "label", vector_to_array("features").alias("x"))
    return _svm_folds(d.filter(F.col("split") == "train"), L.CV_FOLDS), te


@register("svm_fit")
def svm_fit(spark, sf):
    """Machines with each of the three kernels, applied to the test rows."""
    tr, te = _svm_split(features(spark, sf))
    kernels = [SV.Kernel(k, SVM_GAMMA if k != "linear" else 1.0) for k in L.SVM_GRID["kernel"]]
    _, _, found, marks = _machines(tr, kernels, 0)
    names = spark.createDataFrame([(i, k.kind) for i, k in enumerate(kernels)], "map int, kernel string")
    got = _apply(te, kernels, marks, found[SVM_COST]).join(names, "map")
    return got.select("row_id", "kernel", "label", (F.col("margin") > 0).cast("double").alias("prediction"))


@register("svm_grid")
def svm_grid(spark, sf, grid=L.SVM_GRID, folds=L.CV_FOLDS):
    """The grid of kernel machines by ten stratified folds of the training
    rows: 63 points.  All kernels and folds are fitted in the same rounds, the
    costs in ascending order, each from the solution of the one before."""
    tr = _svm_folds(features(spark, sf).filter(F.col("split") == "train"), folds)
    return _svm_scores(tr, grid, folds)


def _svm_scores(tr, grid, folds):
    spark = tr.sparkSession
    kernels = _kernels(grid)
    held, names, found, _ = _machines(tr, kernels, folds, grid["C"])
    at = {(k.kind, k.gamma): i for i, k in enumerate(kernels)}
    scores = {(c, r["map"]): r["score"] for c, w in found.items()
              for r in SV.fold_accuracy(held, w, names).groupBy("map").agg(F.avg(F.col("correct") / F.col("n")).alias("score")).collect()}
    rows = [("SVM", json.dumps(p, sort_keys=True), scores.get((p["C"], at[p["kernel"], 1.0 if p["kernel"] == "linear" else p["gamma"]])))
            for p in _points(grid)]
    return spark.createDataFrame(rows, "model string, params string, mean_score double")


def _svm_probability(tr, te, kernels, cost):
    """(map, row_id, label, p1): test rows by the machines of all training rows,
    each on a logistic curve over margins of held-out folds."""
    held, names, found, marks = _machines(tr, kernels, L.CV_FOLDS, [cost])
    out_of_fold = cut_lineage(SV.margins(held, found[cost], names, "own"))
    curves = [(i, *SV.platt(out_of_fold.where(F.col("map") == i))) for i in range(len(kernels))]
    curves = tr.sparkSession.createDataFrame([(i, float(a), float(b)) for i, a, b in curves], "map int, a double, b double")
    got = _apply(te, kernels, marks, found[cost]).join(curves, "map")
    return got.select("map", "row_id", "label", (1 / (1 + F.exp(-(F.col("a") * F.col("margin") + F.col("b"))))).alias("p1"))


@register("svm_probability")
def svm_probability(spark, sf):
    """Probabilities of the test rows by each of the three kernels."""
    tr, te = _svm_split(features(spark, sf))
    kernels = [SV.Kernel(k, SVM_GAMMA if k != "linear" else 1.0) for k in L.SVM_GRID["kernel"]]
    names = spark.createDataFrame([(i, k.kind) for i, k in enumerate(kernels)], "map int, kernel string")
    return _svm_probability(tr, te, kernels, SVM_COST).join(names, "map").select("kernel", "row_id", "p1")


def _best(scores):
    """The parameters that a grid's table puts first."""
    return json.loads(best_of(scores).first()["params"])


def _tuned(spark, d):
    """The best parameters of each grid, searched on the training rows."""
    train = d.filter(F.col("split") == "train")
    rf_rows, n_features = _fold_bins(train, L.RF_GRID_FOLDS)
    gbt_rows, _ = _fold_bins(train, L.CV_FOLDS)
    return (_best(_rf_scores(rf_rows, n_features, L.RF_GRID_EN, L.RF_GRID_FOLDS)), _best(_gbt_scores(gbt_rows, L.GBT_GRID, L.CV_FOLDS)),
            _best(_svm_scores(_svm_folds(train, L.CV_FOLDS), L.SVM_GRID, L.CV_FOLDS)))


def _forest_of(rows, n_features, p, fold, weights):
    return TR.forest(rows, p["trees"], weights[fold], n_features, p["features"], p["criterion"], p["depth"], p["leaf"], fold, L.SEEDS["boosted"])


def _kernel_of(p):
    return SV.Kernel(p["kernel"], 1.0 if p["kernel"] == "linear" else p["gamma"])


@register("model_comparison")
def model_comparison(spark, sf):
    """The tuned classifiers of the three grids, refitted on the training rows:
    the points of their ROC curves on the test rows and the areas below, one
    row per point."""
    d = features(spark, sf)
    rf_p, gbt_p, svm_p = _tuned(spark, d)
    both, n_features = _bins(d, ["row_id", "label", "split"])
    tr, te = both.filter("split = 'train'").withColumn("fold", F.lit(0)), both.filter("split = 'test'")
    forest = _forest_of(tr, n_features, rf_p, -1, TR.balanced(tr, 0))
    forest = [TR.cut(t, rf_p["split"]) for t in TR.grow(tr, forest, TR.bootstrap_sums(forest, "row_id", "label"))]
    boosted = TR.boosted_fit(tr, TR.Boosted(gbt_p["depth"], gbt_p["rate"]), gbt_p["trees"])
    folded, arrays = _svm_split(d)
    keep = ["row_id", "label"]
    scored = {"RandomForestClassifier": TR.forest_predict(te, forest, keep), "GBTClassifier": TR.boosted_predict(te, boosted, gbt_p["rate"], keep),
              "SVC": _svm_probability(folded, arrays, [_kernel_of(svm_p)], svm_p["C"])}
    out = None
    for name, s in scored.items():
        s = cut_lineage(s.select("row_id", F.col("label").cast("int").alias("label"), F.col("p1").alias("score")))
        auc = float(CL.roc_auc(s).first()[0])  # one number per classifier
        curve = CL.roc_curve(s).select(F.lit(name).alias("classifier"), "threshold", "fpr", "tpr", F.lit(auc).alias("auc"))
        out = curve if out is None else out.unionByName(curve)
    return out


#: Mean and deviation of fold scores, over a table ``scores`` (the operator's SQL form).
FOLD_SUMMARY_SQL = ("SELECT model, fold, score, avg(score) OVER (PARTITION BY model) AS mean, "
                    "stddev_pop(score) OVER (PARTITION BY model) AS std FROM scores")


def fold_summary(scores):
    """Each fold's score with the mean and population deviation of its model."""
    summ = scores.groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return scores.join(summ, "model")


@register("cv_scores")
def cv_scores(spark, sf, folds=L.CV_FOLDS):
    """Accuracy per stratified fold of all event rows for the tuned classifier
    of each grid, with mean and population deviation per model."""
    d = features(spark, sf)
    rf_p, gbt_p, svm_p = _tuned(spark, d)
    rows, n_features = _fold_bins(d, folds)
    weights = TR.balanced(rows, folds)
    forests = [_forest_of(rows, n_features, rf_p, f, weights) for f in range(folds)]
    share = F.col("correct") / F.col("n")
    rf = (TR.forest_grid(rows, forests, [rf_p["trees"]], [rf_p["depth"]], [rf_p["split"]])
          .select(F.lit("RF").alias("model"), "fold", share.alias("score")))
    # model i holds out fold i
    gbt = (TR.boosted_scores(rows, [TR.Boosted(gbt_p["depth"], gbt_p["rate"], f) for f in range(folds)], [gbt_p["trees"]])
           .select(F.lit("XGB").alias("model"), F.col("model").alias("fold"), share.alias("score")))
    held, names, found, _ = _machines(_svm_folds(d, folds), [_kernel_of(svm_p)], folds, [svm_p["C"]])
    svm = SV.fold_accuracy(held, found[svm_p["C"]], names).select(F.lit("SVM").alias("model"), "fold", share.alias("score"))
    return fold_summary(cut_lineage(rf.unionByName(gbt).unionByName(svm)))


@register("score_text_model")
def score_text_model(spark, sf):
    """Tokenizer, mean word vector and classifier as one pipeline, fitted on the
    training rows, stored, loaded again, and applied to the raw text of all
    labelled posts."""
    from pyspark.ml import Pipeline, PipelineModel
    ev = CL.split_train_test(events(spark, sf).withColumn("label", F.col("label").cast("double")), 0.3, SEED)
    train = ev.filter(F.col("split") == "train").select("row_id", "label")
    posts = TB.labelled(spark, sf, text_work=True).select("row_id", "text")
    stages = [VX.CleanTokenizer("text", "toks"), VX.MeanEmbedding(vectors(spark, sf), DIM, inputCol="toks", outputCol="features"),
              CL.rf(trees=10, depth=5, weight_col="weight")]
    p = scratch_path(spark, "score_text")
    Pipeline(stages=stages).fit(CL.with_weights(posts.join(train, "row_id"), "label", "weight")).write().save(p)
    return PipelineModel.load(p).transform(posts).select("row_id", "prediction")
