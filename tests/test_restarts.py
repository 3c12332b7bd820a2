from textlens.operators import topic_models as TM
from textlens.plans import q_topics as Q
from textlens.plans.catalog import queries


def test_restarts_go_on_until_the_threshold_is_reached(spark, monkeypatch):
    """With the fits and scores replaced: tries up to the first that reaches it."""
    seeds = []

    def fit(bags, settings, n):
        seeds.extend(s.seed for s in settings)
        assert all((s.k, s.passes) == (100, 1) for s in settings)
        return len(settings)

    def coherence(models, f, c, tokens, window, topn):
        assert (window, topn) == (10, 10)
        first = len(seeds) - models
        rows = [(m, t, 0.98 if first + m == 10 and t == 1 else 0.1 * t) for m in range(models) for t in range(3)]
        return spark.createDataFrame([*rows, (0, 3, float("nan"))], "model int, topic int, coherence double")

    monkeypatch.setattr(Q, "_features", lambda spark, sf: (None, spark.range(3), None))
    monkeypatch.setattr(Q.TM, "fit", fit)
    monkeypatch.setattr(Q.TM, "coherence", coherence)
    rows = queries()["lda_restarts"](spark, "").orderBy("try").collect()
    assert [r["best_coherence"] for r in rows] == [0.2] * 10 + [0.98]
    assert [r["reached"] for r in rows] == [False] * 10 + [True] and rows[-1]["best_topic"] == 1
    assert seeds == list(range(100, 116)) and [r["seed"] for r in rows] == list(range(100, 111))
    seeds.clear()
    few = Q.lda_restarts(spark, "", max_tries=3).collect()
    assert len(few) == 3 and not any(r["reached"] for r in few)


def test_tuned_settings_are_the_declared_ones():
    assert (Q.TUNED.k, Q.TUNED.alpha, Q.TUNED.eta, Q.TUNED.passes, Q.TUNED.chunk, Q.TUNED.seed) == (5, "asymmetric", 0.91, 50, 100, 100)
    assert isinstance(Q.BASIC, TM.Setting) and Q.BASIC.passes == 100
