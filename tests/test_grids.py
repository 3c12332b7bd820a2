"""The grids give a row for every point of their settings."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from textlens import lexicons as L
from textlens.operators import topic_models as TM
from textlens.plans import q_models as M
from textlens.plans import q_topics as Q
from textlens.plans.catalog import queries

from .conftest import SF_SMALL

SMALL_RF = dict(trees=[2, 3], features=["log2", "auto"], criterion=["entropy", "gini"], depth=[2, 3], split=[2, 8], leaf=[1, 5])
SMALL_GBT = dict(depth=[2, 3], trees=[2, 4], rate=[0.1, 0.05])
SMALL_SVM = dict(C=[1, 10], kernel=["rbf", "linear", "poly"], gamma=[0.01, 0.5])


def test_declared_grids():
    assert [len(M._points(g)) for g in (L.RF_GRID_EN, L.GBT_GRID, L.SVM_GRID)] == [4200, 96, 63]
    assert len(L.LDA_GRID_TOPICS) * len(L.LDA_GRID_ALPHA) * len(L.LDA_GRID_BETA) == 180


@pytest.mark.parametrize("query,grid", [(M.rf_grid, SMALL_RF), (M.gbt_grid, SMALL_GBT), (M.svm_grid, SMALL_SVM)])
def test_a_row_for_each_point(spark, query, grid):
    rows = query(spark, SF_SMALL, grid, 3).collect()
    assert sorted(r["params"] for r in rows) == sorted(json.dumps(p, sort_keys=True) for p in M._points(grid))
    assert all(0 <= r["mean_score"] <= 1 for r in rows)
    if query is M.svm_grid:  # gamma is no setting of the linear machine
        line = {(p["C"], r["mean_score"]) for r in rows if (p := json.loads(r["params"]))["kernel"] == "linear"}
        assert len(line) == 2


def test_best_parameters_and_fold_summary_match_sql(spark):
    rows = [("RF", f"p{i}", [0.5, 0.9, 0.9, 0.1][i % 4]) for i in range(12)] + [("GBT", "q", 0.3)]
    grid = spark.createDataFrame(rows, "model string, params string, mean_score double")
    con = duckdb.connect()
    con.register("grid", grid.toPandas())
    assert sorted(map(tuple, M.best_of(grid).collect())) == sorted(con.execute(M.BEST_SQL).fetchall())
    scores = spark.createDataFrame([(m, f, (f * 7 % 5) / 5) for m in ("RF", "SVM") for f in range(10)], "model string, fold int, score double")
    con.register("scores", scores.toPandas())
    want = {(a, b): (c, d, e) for a, b, c, d, e in con.execute(M.FOLD_SUMMARY_SQL).fetchall()}
    for r in M.fold_summary(scores).select("model", "fold", "score", "mean", "std").collect():
        assert all(abs(x - y) < 1e-12 for x, y in zip(r[2:], want[r["model"], r["fold"]]))


def test_topic_grid_covers_every_point(spark, monkeypatch):
    seen = []

    def fit(bags, settings, n):
        seen.extend(settings)
        return None

    def coherence(models, f, c, tokens):
        return spark.range(180).select(F.col("id").cast("int").alias("model"), F.lit(0).alias("topic"), F.lit(0.5).alias("coherence"))

    monkeypatch.setattr(Q, "_features", lambda spark, sf: (None, spark.range(3), None))
    monkeypatch.setattr(TM, "fit", fit)
    monkeypatch.setattr(TM, "coherence", coherence)
    got = queries()["lda_grid"](spark, SF_SMALL).collect()
    assert len({tuple(r)[1:4] for r in got}) == len(set(seen)) == 180
    assert {(s.passes, s.chunk) for s in seen} == {(50, 100)}
