import random
import re

import numpy as np
import pytest
from textlens.llm import ngram_join as J
from textlens.llm.components import components

from .helpers import ODD, documents, edited, prose


def brute(rows, size=5, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def rows():
    rng = random.Random(7)
    passage = prose(99, 55)
    out, texts = [], []
    for g in range(12):
        base = prose(g, rng.randrange(5, 160))
        texts += [base] * rng.randrange(1, 4) + [edited(base, 10 * g + k, rng.randrange(0, 5)) for k in range(rng.randrange(6))]
    texts += [prose(500 + k, 60) + " " + passage for k in range(15)]
    texts += [passage + " " + prose(700 + k, n) for k, n in enumerate([3, 3, 4, 5, 6, 7, 8])]
    texts += ["A b C", "a B c", "a b", "x y z w", "x y z w v", "X y z w v"]
    texts += [t for t in ODD]
    ids = rng.sample(range(10_000), len(texts))
    out = list(zip(ids, texts))
    rng.shuffle(out)
    return out


def chained():
    """Each text links with the next only: one long chain."""
    words = prose(1, 400, 10 ** 6).split()
    return [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(60)]


@pytest.mark.parametrize("case", [rows, chained])
def test_against_brute_force(spark, case, monkeypatch):
    data = case()
    for limits in ((4_000_000, 20_000), (300, 3)):  # the second cuts blocks in chunks
        monkeypatch.setattr(J, "CHUNK_SHINGLES", limits[0])
        monkeypatch.setattr(J, "CHUNK_CLASSES", limits[1])
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(documents(spark, data)).collect()}
        assert got == brute(data)


def test_search_in_memory_against_all_pairs():
    rng = np.random.default_rng(3)
    for case in range(60):
        pool = rng.integers(0, 60 if case % 2 else 400, 300).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 40))) for _ in range(25)]
        sets += [np.unique(np.concatenate([s[: max(1, int(len(s) * 0.9))], rng.integers(1000, 2000, 2).astype(np.uint64)])) for s in sets[:12]]
        for percent in (80, 60):
            group = list(range(len(sets)))
            for a, b in J.search(sets, percent):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
                assert group[a] != group[b]  # a forest
                group = [group[a] if g == group[b] else g for g in group]
            for a in range(len(sets)):
                for b in range(a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        assert group[a] == group[b]


def test_empty_and_repeated_rows(spark):
    assert J.near_duplicates(documents(spark, [])).count() == 0
    text = prose(1, 30)
    got = sorted((r["doc_id"], r["component_id"]) for r in J.near_duplicates(documents(spark, [(3, text), (3, text), (9, text), (4, None)])).collect())
    assert got == [(3, 3), (3, 3), (4, 4), (9, 3)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {n for n in root if not any(n in e and e[0] != e[1] for e in edges)}
    assert got == {n: r for n, r in root.items() if n not in alone}
    assert components(spark.createDataFrame([], "u long, v long"), "none").count() == 0
