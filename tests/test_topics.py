"""Phrases, window counts and topic fits against plain versions."""

import random

from textlens.operators import topics as TP


def merge(tokens, phrases):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in phrases:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def texts(n=60, size=40, vocabulary="abcde"):
    rng = random.Random(4)
    return [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(size))]) for i in range(n)] + [(900, []), (901, ["a"])]


def test_phrase_merge_against_a_loop(spark):
    rows = texts() + [(902, ["a", "b"] * 10_000)]
    phrases = [("a", "b"), ("b", "c"), ("c", "c"), ("d", "a")]
    df = spark.createDataFrame(rows, "row_id long, toks array<string>")
    got = {r["row_id"]: r["toks"] for r in TP.phrase_apply(df, "toks", spark.createDataFrame(phrases, "a string, b string")).collect()}
    assert got == {i: merge(t, set(phrases)) for i, t in rows}
    none = TP.phrase_apply(df, "toks", spark.createDataFrame([], "a string, b string"))
    assert {r["row_id"]: r["toks"] for r in none.collect()} == dict(rows)


def test_window_counts_against_all_windows(spark):
    rows = texts() + [(903, ["a"] + ["z"] * 20_000 + ["b", "a"])]
    top = ["a", "b", "d"]
    for window in (1, 3, 10, 200):
        want = {}
        for _, t in rows:
            for i in range(max(len(t) - window, 0) + 1):
                w = sorted(set(t[i:i + window]) & set(top))
                want[None, None] = want.get((None, None), 0) + 1
                for x in w:
                    for y in w:
                        if x <= y:
                            want[x, y] = want.get((x, y), 0) + 1
        df = spark.createDataFrame([(t,) for _, t in rows], "toks array<string>")
        assert {(r["a"], r["b"]): r["n"] for r in TP.window_counts(df, "toks", top, window).collect()} == want


def test_topic_map_keeps_the_distances(spark):
    import math

    import numpy as np
    rng = random.Random(2)
    weights = {t: {f"w{i}": rng.random() for i in range(t, t + 6)} for t in range(4)} | {9: {"alone": 3.0}}
    df = spark.createDataFrame([(t, w, x) for t, ws in weights.items() for w, x in ws.items()], "topic int, term string, weight double")
    share = {t: {w: x / sum(ws.values()) for w, x in ws.items()} for t, ws in weights.items()}

    def jsd(a, b):
        out = 0.0
        for w in share[a] | share[b]:
            p, q = share[a].get(w, 0), share[b].get(w, 0)
            out += sum(0.5 * v * math.log(2 * v / (p + q)) for v in (p, q) if v)
        return out

    got = {(r["a"], r["b"]): r["distance"] for r in TP.topic_distances(df).collect()}
    assert set(got) == {(a, b) for a in weights for b in weights if a < b}
    assert all(abs(got[a, b] - jsd(a, b)) < 1e-12 for a, b in got)
    assert abs(got[0, 9] - math.log(2)) < 1e-12
    spots = {r["topic"]: r for r in TP.topic_map(df).collect()}
    whole = sum(x for ws in weights.values() for x in ws.values())
    assert all(abs(spots[t]["share"] - sum(ws.values()) / whole) < 1e-12 for t, ws in weights.items())
    # points that lie in a plane come back with their distances
    xy = np.asarray([(0, 0), (3, 0), (0, 4), (1, 1.0)])
    d = np.linalg.norm(xy[:, None] - xy, axis=2)
    back = TP.classical_scaling(d)
    assert np.allclose(np.linalg.norm(back[:, None] - back, axis=2), d)
    assert TP.classical_scaling(np.zeros((1, 1))).tolist() == [[0.0, 0.0]]


def test_places_of_a_text_do_not_meet_each_other(spark):
    """Ranges met in pairs per text, the square of its places; long texts over many blocks count the same."""
    rng = random.Random(3)
    text = [rng.choice("abcz") for _ in range(900)] + ["z"] * 300 + ["a", "b"] * 40
    df = spark.createDataFrame([(text,), (None,), ([],), (["a"],)], "toks array<string>")
    for window in (10, 110):
        want = {}
        for t in (text, [], [], ["a"]):
            for i in range(max(len(t) - window, 0) + 1):
                w = sorted(set(t[i:i + window]) & {"a", "b", "c"})
                for x in w:
                    for y in w:
                        if x <= y:
                            want[x, y] = want.get((x, y), 0) + 1
                want[None, None] = want.get((None, None), 0) + 1
        counts = TP.window_counts(df, "toks", ["a", "b", "c"], window)
        assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == want
        assert "Join" not in counts._jdf.queryExecution().toString()
