import random
import re
from collections import Counter

import numpy as np
import pytest
from textlens.llm import quality_rules as Q

from .helpers import ODD, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def texts():
    rng = random.Random(4)
    made = [prose(i, rng.randrange(5, 300), 30) for i in range(40)]
    made += ["\n".join(rng.choice(["a b c", "a b c ", "d", "", " ", "long line of words here"]) for _ in range(60)) for _ in range(20)]
    return made + ["\x0b\x0c\r\x85\xa0 é  x"] + ODD


def labelled(spark):
    good = [(i, prose(i, 60)) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(120)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_base_columns_and_odd_texts(spark):
    rows = list(enumerate(texts()))
    docs, labels = labelled(spark)
    model = Q.fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in Q.score_quality(documents(spark, rows + [rows[0]]), model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), text and text[:60]
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["probability"] <= 1


def test_model_separates_held_out_rows_and_agrees_with_reruns(spark):
    docs, labels = labelled(spark)
    model = Q.fit_quality(docs, labels, max_rows=80)
    fresh = documents(spark, [(i, prose(i, 60)) for i in range(5000, 5050)] + [(i, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(6000, 6050)])
    got = {r["doc_id"]: r["kept"] for r in Q.score_quality(fresh, model).collect()}
    assert all(got[i] == (i < 6000) for i in got)
    again = Q.fit_quality(docs.repartition(5), labels, max_rows=80)
    assert (again.weights == model.weights).all() and again.slope == model.slope


def test_without_two_classes_and_empty(spark):
    docs, labels = labelled(spark)
    model = Q.fit_quality(docs, labels.where("quality = 1"))
    assert all(r["kept"] != r["base_failed"] for r in Q.score_quality(docs, model).collect())
    assert Q.score_quality(docs.limit(0), model).count() == 0


def test_keep_good_returns_own_columns(spark):
    docs, labels = labelled(spark)
    kept = Q.keep_good(docs, Q.fit_quality(docs, labels))
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == set(range(300)) and {r["kept"] for r in kept.collect()} == {"x"}


def test_calibration_does_not_depend_on_the_sample_bound(spark):
    rng = random.Random(8)

    def mingled(share):  # the classes overlap: a word is marked more often in bad rows
        return " ".join(w + "%%%" * (rng.random() < share) for w in prose(rng.randrange(10**6), 40).split())

    good = [(i, mingled(rng.uniform(0, 0.5))) for i in range(1600)]
    bad = [(5000 + i, mingled(rng.uniform(0.2, 0.7))) for i in range(200)]
    docs = documents(spark, good + bad).cache()
    labels = spark.createDataFrame([(i, int(i < 5000)) for i, _ in good + bad], "doc_id long, quality int")
    for max_rows in (2000, 200):  # the mean probability is the share of good labels (8 of 9), not the sample's
        rows = Q.score_quality(docs, Q.fit_quality(docs, labels, max_rows=max_rows)).select("probability").collect()
        assert abs(sum(r["probability"] for r in rows) / len(rows) - 8 / 9) < 0.08, max_rows


def test_offset_of_a_weighted_sample():
    rng = np.random.default_rng(3)
    y = np.repeat([1.0, 0.0], [16_000, 2_000])
    margin = rng.normal(np.where(y == 1, 1, -1), 1.5)
    some = np.r_[:2_000, 16_000:18_000]
    whole = Q._platt(margin, y, np.ones(len(y)))
    assert Q._platt(margin[some], y[some], np.where(y[some] == 1, 8.0, 1.0)) == pytest.approx(whole, abs=0.15)
