import random

import numpy as np
from textlens.llm import quality_gam as G

from .helpers import ODD, documents, prose


def test_learns_single_features_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4))
    p = 1 / (1 + np.exp(-(3 * np.sign(x[:, 0]) + 4 * np.sign(x[:, 1] * x[:, 2]))))
    y = (rng.uniform(size=3000) < p).astype(float)
    model = G.train(x[:2000], y[:2000], np.ones(2000))
    assert set(model.pairs[0]) == {1, 2}
    score = model.score(x[2000:])
    assert ((score > 0.5) == (p[2000:] > 0.5)).mean() > 0.93
    assert abs(score.mean() - y[2000:].mean()) < 0.05
    at = model.bins(x[:50])
    total = model.base + sum(t[b] for t, b in zip(model.tables, at)) + sum(g[at[i], at[j]] for (i, j), g in zip(model.pairs, model.grids))
    assert np.allclose(1 / (1 + np.exp(-total)), model.score(x[:50]))


def test_trees_against_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.normal(size=7), rng.uniform(0.1, 2, 7)
        tree = G.shallow_tree(g, h, leaves=2)
        gains = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) for k in range(1, 7)]
        k = int(np.argmax(gains)) + 1
        assert np.allclose(tree[:k], -g[:k].sum() / (h[:k].sum() + 1)) and np.allclose(tree[k:], -g[k:].sum() / (h[k:].sum() + 1))
        grid, gain = G.crossed_tree(rng.normal(size=(4, 5)), rng.uniform(0.1, 2, (4, 5)))
        assert grid.shape == (4, 5) and gain >= 0 and len(np.unique(grid)) <= 4


def junk(seed):
    rng = random.Random(seed)
    return rng.choice([" ".join(w + "%%%" for w in prose(seed, 50).split()), " | ".join(prose(seed, 50).split()), (prose(seed, 8) + " ") * 9, prose(seed, 50).upper() + "!!"])


def test_held_out_accuracy_and_odd_texts(spark):
    rows = [(i, prose(i, 60 + i % 50)) for i in range(500)] + [(i, junk(i)) for i in range(500, 750)]
    docs = documents(spark, rows + [(10_000 + i, t) for i, t in enumerate(ODD)])
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = G.fit_gam(docs, labels)
    got = G.score_gam(docs, model).join(docs.select("doc_id", G.held_out(docs["doc_id"]).alias("out")), "doc_id").collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["out"] and r["doc_id"] < 1000]
    assert len(out) > 80 and np.mean([(r["score"] >= G.THRESHOLD) == (r["doc_id"] < 500) for r in out]) > 0.95
    # labels of held-out rows do not matter
    flipped = labels.withColumn("quality", G.F.when(G.held_out(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]))
    again = G.fit_gam(docs.repartition(3), flipped)
    assert again.base == model.base and all((a == b).all() for a, b in zip(again.tables, model.tables))


def test_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in G.score_gam(docs, G.fit_gam(docs, none)).collect()} == {0.5}
    assert G.score_gam(docs.limit(0), G.fit_gam(docs, none)).count() == 0
