"""Word vectors by vocabulary blocks."""

import numpy as np

from textlens import lexicons as L
from textlens.operators import skipgram as SG
from textlens.operators import vectors as VX
from textlens.plans import q_vectors as Q
from textlens.plans.catalog import queries

from .conftest import SF_SMALL


def planted(spark, n=300, seed=3):
    """Texts in which "tram" and "metro" stand between the same words, as do
    "apple" and "pear"; each text is about one of the two pairs."""
    rng = np.random.default_rng(seed)
    about = {"ride": ["station", "track", "driver", "ticket", "platform"], "food": ["sweet", "juice", "tree", "basket", "peel"]}
    names = {"ride": ["tram", "metro"], "food": ["apple", "pear"]}
    rows = []
    for i in range(n):
        k = ("ride", "food")[i % 2]
        rows.append((i, [str(x) for _ in range(6) for x in (rng.choice(about[k]), names[k][rng.integers(2)], rng.choice(about[k]), f"w{rng.integers(40)}")]))
    return spark.createDataFrame(rows, "row_id long, toks array<string>").repartition(4)


SETTINGS = dict(size=24, window=3, min_count=1, negative=4, seed=5)


def similar(model, word):
    rows = model.select("word", "vector").collect()
    v = {r["word"]: np.asarray(r["vector"]) for r in rows}
    unit = {w: x / np.linalg.norm(x) for w, x in v.items()}
    return sorted((w for w in v if w != word), key=lambda w: -(unit[w] @ unit[word]))


def test_planted_synonyms_come_out_nearest(spark, monkeypatch):
    monkeypatch.setattr(SG, "LEAST_WORDS", 12)
    monkeypatch.setattr(SG, "SAMPLE", 1.0)
    df = planted(spark)
    model = SG.fit(df, "toks", iters=30, **SETTINGS)
    for a, b in (("tram", "metro"), ("apple", "pear")):
        assert similar(model, a)[0] == b and similar(model, b)[0] == a
    assert VX.nearest_terms(model.select("word", F_double("vector")), "tram", 1).first()["word"] == "metro"
    words = {w for r in df.collect() for w in r["toks"]}
    assert {r["word"] for r in model.collect()} == words


def F_double(c):
    from pyspark.sql import functions as F
    return F.transform(c, lambda x: x.cast("double")).alias(c)


def test_pairs_are_those_of_the_window(spark, monkeypatch):
    monkeypatch.setattr(SG, "SAMPLE", 1.0)
    monkeypatch.setattr(SG, "LEAST_WORDS", 2)
    rows = [(1, ["a", "b", "c", "a", "rare"]), (2, ["d"]), (3, []), (4, ["e", "e"])]
    df = spark.createDataFrame(rows, "row_id long, toks array<string>")
    vocab, blocks, total = SG.vocabulary(df, "toks", 1, 4)
    name = {(r["block"], r["at"]): r["word"] for r in vocab.collect()}
    assert blocks > 1 and total == 8 and len(name) == 6
    got = []
    for r in SG.pairs(df, "toks", vocab, blocks, 2, total).collect():
        j = (r["i"] + r["r"]) % blocks
        for a, b, c in zip(*(np.frombuffer(r[x], k).tolist() for x, k in (("words", "<i4"), ("contexts", "<i4"), ("chances", "<f4")))):
            got.append((name[r["i"], a], name[j, b], round(c, 3)))
    want = []
    for _, toks in rows:
        for x, a in enumerate(toks):
            want += [(a, toks[y], (2 - abs(x - y) + 1) / 2) for y in range(max(0, x - 2), min(len(toks), x + 3)) if y != x]
    assert sorted(got) == sorted(want)


def test_a_fit_goes_on_from_fitted_vectors(spark, monkeypatch):
    monkeypatch.setattr(SG, "LEAST_WORDS", 12)
    df = planted(spark, 60)
    first = SG.fit(df, "toks", iters=5, **SETTINGS)
    same = SG.fit(df, "toks", iters=5, **SETTINGS)
    as_dict = lambda m: {r["word"]: np.asarray(r["vector"]) for r in m.collect()}
    a, b = as_dict(first), as_dict(same)
    assert all(np.allclose(a[w], b[w], atol=1e-5) for w in a)  # reruns agree
    monkeypatch.setattr(SG, "RATE", 0.0)
    monkeypatch.setattr(SG, "LAST_RATE", 0.0)
    kept = as_dict(SG.fit(df, "toks", iters=2, fitted=first, **SETTINGS))
    assert all(np.array_equal(a[w], kept[w]) for w in a)
    bare = df.where("row_id < 0")
    assert SG.fit(bare, "toks", iters=2, **SETTINGS).count() == 0


def test_registered_fits_take_the_declared_settings(spark, monkeypatch):
    seen = []

    def fit(df, tokens, iters, fitted=None, **settings):
        seen.append((iters, fitted is not None, settings))
        return spark.createDataFrame([("w", 1, [0.0], [0.0])], "word string, freq long, vector array<float>, context array<float>")

    monkeypatch.setattr(Q.SG, "fit", fit)
    queries()["w2v_fit"](spark, SF_SMALL)
    queries()["w2v_continue"](spark, SF_SMALL)
    p = {k: v for k, v in L.W2V_EN.items() if k != "iters"}
    assert [s[2] for s in seen] == [p] * 3
    assert [s[:2] for s in seen] == [(100, False), (100, False), (10, True)]


def test_pairs_of_many_blocks_cost_their_bytes():
    """A task held a piece of its own per text, distance and bucket, some 400 bytes for one pair."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(4)
    n, blocks, window = 20_000, 100, 6
    codes = (rng.integers(blocks, size=n) << 32) + rng.integers(500, size=n)
    batch = pa.RecordBatch.from_pydict({"codes": pa.array([codes]), "keeps": pa.array([np.ones(n, np.float32)])})
    tracemalloc.start()
    got = pairs = 0
    for out in SG.dealt_pairs([batch], blocks, window):
        got, pairs = got + out.num_rows, pairs + len(out.column("words")[0].as_py()) // 4
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == sum(2 * (n - d) for d in range(1, window + 1)) and got == blocks * blocks
    assert peak < 100 * pairs


def test_held_pairs_are_written_in_between(spark, monkeypatch):
    """Any bound on the held pairs gives the same pairs."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    texts = [(rng.integers(3, size=n) << 32) + rng.integers(9, size=n) for n in (0, 1, 7, 30, 400)]
    batch = pa.RecordBatch.from_pydict({"codes": pa.array(texts), "keeps": pa.array([np.full(len(t), 0.5, np.float32) for t in texts])})

    def all_pairs():
        out = []
        for r in (r for b in SG.dealt_pairs([batch], 3, 4) for r in b.to_pylist()):
            w, c, p = (np.frombuffer(r[x], k).tolist() for x, k in (("words", "<i4"), ("contexts", "<i4"), ("chances", "<f4")))
            out += [(r["i"], (r["i"] + r["r"]) % 3, *x) for x in zip(w, c, p)]
        return sorted(out)

    whole = all_pairs()
    monkeypatch.setattr(SG, "HELD_PAIRS", 20)
    assert all_pairs() == whole and len(whole) > 3_000
