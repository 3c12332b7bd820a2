import random
import time
import re

import pytest
from textlens.llm import licenses as L

from .helpers import ODD, documents


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))


def test_base_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["MIT", "license", "License,", "apache", "general", "public", "é", "mit\nlicense", "x-mit_license", "\x7f", "licenseé", "General Public License", "ö"]
    rows = list(enumerate([" ".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)] + ODD))
    got = {r["doc_id"]: r for r in L.scan_licenses(documents(spark, rows)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert L.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text,labels,worth", [
    ("mit or gpl-3.0-only", ["mit", "gpl"], 1.0), ("mit and gpl-3.0-only", ["mit", "gpl"], 0.4),
    ("gpl-2.0-only and mit or apache-2.0", ["gpl", "mit", "apache"], 1.0), ("gpl-2.0-only and (mit or apache-2.0)", ["gpl", "mit", "apache"], 0.4),
    ("gpl-2.0-or-later with classpath-exception-2.0", ["gpl"], 0.7), ("(mit) */", ["mit"], 1.0), ("mit and", ["mit"], 1.0),
    ("lgpl-2.1+ and (bsd-3-clause or foo)", ["lgpl", "bsd"], 0.6), (") mit", [], None), ("", [], None), ("foo or bar", [], None), ("((mit", ["mit"], 1.0)])
def test_expressions(text, labels, worth):
    assert L.expression(text) == (labels, pytest.approx(worth) if worth is not None else None)


def test_tags_and_notices():
    r = L.scan(b"// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\ncode\n# spdx-license-identifier: MIT")
    assert r["labels"] == "gpl,mit" and r["score"] == 0.7 and r["n_base"] == 0
    assert L.scan(b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    assert L.scan(b"All rights reserved.")["score"] == 0.0 and L.scan(b"no notice")["score"] == 0.5


def test_time_grows_with_the_text():
    took = []
    for n in (20_000, 160_000):
        begin = time.process_time()
        assert L.scan(b"mit license " * n)["last_word"] == 2 * n - 2
        took.append(time.process_time() - begin)
    assert took[1] < 40 * took[0] + 0.5


def test_a_lesser_licence_is_worth_its_own():
    r = L.scan(b"GNU Lesser General Public License")
    assert (r["base_labels"], r["labels"], r["score"]) == ("gpl", "gpl,lgpl", 0.6)
    assert L.scan(b"General Public License and Lesser General Public License")["score"] == 0.4
