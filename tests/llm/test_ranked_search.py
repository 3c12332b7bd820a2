import math
import random
import re

import duckdb
import numpy as np
from textlens.llm import ranked_search as S

from ..conftest import SF_SMALL
from .helpers import ODD, documents, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, k=10):
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, all_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked = [x for x in plain_terms(text) if x in df]
        scores = []
        for i, t in held:
            m = 25 + 75 * len(t) * n_docs // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * t.count(x) // (1000 * t.count(x) + 8 * m))
                    for x in asked)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def table_of_items(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def fixture():
    rng = random.Random(4)
    docs = list(enumerate([*ODD, *[prose(i, rng.randrange(1, 90), 120) for i in range(300)]]))
    docs += [(900 + i, prose(3, 40, 120)) for i in range(60)]  # equal scores
    docs += [(7, "w1x w2x W3X"), (7, "w1x w2x W3X"), (None, "w1x w2x w9x")]
    items = [(i, prose(50 + i, 12, 120)) for i in range(12)] + [(20, None), (21, " ! "), (22, "nowhere"), (23, "W1x w1X, w1x é"), (23, "w5x")]
    return docs, items


def test_ranking_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(S, "TREE_TERMS", 900)
    monkeypatch.setattr(S, "LEAF", 3)
    df = documents(spark, docs).repartition(5)
    want = sorted(plain_ranking(docs, items), key=str)
    assert rows(S.ranked(df, table_of_items(spark, items))) == want
    # in blocks, with k beyond the number of hits of some items
    want = sorted(plain_ranking(docs, items, 40), key=str)
    assert rows(S.ranked(df, table_of_items(spark, items), k=40, block_bytes=200)) == want


def test_empty_tables(spark):
    docs, items = fixture()
    assert S.ranked(documents(spark, []), table_of_items(spark, items)).count() == 0
    assert S.ranked(documents(spark, docs[:20]), table_of_items(spark, [])).count() == 0
    assert S.ranked(documents(spark, [(1, None), (2, " ")]), table_of_items(spark, items)).count() == 0


def random_tree(rng, n, leaf):
    vectors = [np.unique(rng.zipf(1.5, rng.integers(1, 30)) % 60) for _ in range(n)]
    vectors += [vectors[0]] * 40
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    terms = np.concatenate(vectors)
    tf, m = rng.integers(1, 9, len(terms)), rng.integers(25, 400, len(vectors))
    return S.Tree(list(range(len(vectors))), starts, terms, tf, m, leaf), vectors, starts, tf, m


def test_bounds_hold_and_subtrees_are_passed_over():
    rng = np.random.default_rng(6)
    tree, vectors, starts, tf, m = random_tree(rng, 400, 8)
    assert sum(1 for c in tree.children if c) > 5
    gain = np.zeros(60, np.int64)
    gain[rng.integers(0, 60, 6)] = rng.integers(1, 5000, 6)
    score = {}
    for d, v in enumerate(vectors):
        w = S.worth(tf[starts[d]:starts[d + 1]], np.full(len(v), m[d]))
        score[d] = int((gain[v] * w).sum())
    for node, (lo, hi) in enumerate(tree.nodes):
        assert tree._most(node, gain) >= max(score[tree.ids[x]] for x in range(lo, hi))
    leaves = [n for n, c in enumerate(tree.children) if not c]
    assert sorted(x for n in leaves for x in range(*tree.nodes[n])) == list(range(len(vectors)))
    best = []
    scored = tree.search(gain, best, 5)
    assert sorted((-s, i.id) for s, i in best) == sorted((-s, d) for d, s in score.items() if s > 0)[:5]
    assert scored < len(leaves)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = sorted(con.execute(S.SQL).fetchall(), key=str)
    assert rows(S.op11_ranked_search(spark, SF_SMALL)) == want and len(want) > 100
