"""Text steps that cost a few tests a letter, whatever the lexicon holds."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from textlens.functions import patterns as P
from textlens.functions import text as T
from textlens.functions import tokens as K


def run(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_trie_branches_by_letter():
    keys = [a + b for a in "abcdef" for b in "uvwxyz"]
    assert P.word_trie(keys).count("a") == 1
    assert P.word_trie(["ab", "a", "ac"]) == r"\b(?:a(?:b||c))\b"


def test_trie_matches_as_the_plain_alternation():
    rng = random.Random(5)

    def word(n):
        return "".join(rng.choice("ab.' ") for _ in range(rng.randint(1, n)))
    for _ in range(300):
        keys = [word(4) for _ in range(rng.randint(1, 8))]
        text = word(30)
        trie, plain = re.compile(P.word_trie(keys)), re.compile(P.word_alternation(keys))
        assert [m.span() for m in trie.finditer(text)] == [m.span() for m in plain.finditer(text)], (keys, text)


def test_replacement_asks_split_for_no_pattern_and_keeps_marks(spark):
    pairs = [("don't", "do not"), ("dont", "do not"), ("x", "y")]
    texts = ["don't dont x", "a\x01x\x01b x", "x", "", None, "xx"]
    assert run(spark, lambda c: T.txt_dict_replace(c, pairs), texts) == ["do not do not y", "a\x01y\x01b y", "y", "", None, "xx"]
    assert P.word_alternation([k for k, _ in pairs]) not in str(T.txt_dict_replace(F.col("t"), pairs))


def test_possessive_takes_one_letter(spark):
    texts = ["a's's", "a's's's", "driver's seat", "'s", "_'s 9's", "é's", "a''s", None]
    want = [None if t is None else re.sub(r"([^\W]+)'s", r"\1", t) for t in texts]
    assert run(spark, T.txt_possessive, texts) == want
    assert "]+)'s" not in str(T.txt_possessive(F.col("t")))


def test_domain_map_keeps_other_tokens(spark):
    got = run(spark, lambda c: K.tok_join(K.tok_map(F.split(c, " "), [("a", "b"), ("c", "d")])), ["a x c", "", None])
    assert got == ["b x d", "", None]


def test_rare_patterns_leave_other_texts_alone(spark):
    """The cleaning chain gives what its steps give one after another; the
    patterns for rare marks are behind a plain search for them."""
    from textlens import lexicons as L
    rng = np.random.default_rng(5)
    bits = ["<b>", "<", ">", "@x", "#", "ht", "http://a", "tp", "pic.twitter.com/q", "twitter", ".com/z ", "don't", "he's", "'", "'s", "\u00b9", "\u00bd", "7",
            " ", "\n", "\x85", "word", "snake_case", "caf\u00e9", "\u0130", "{html}", "RT ", "!?", "-", "\U0001f600", "\u4e2d"]
    texts = [None, "", "plain words only"] + ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rt, pairs in ((False, None), (True, L.CONTRACTIONS), (False, [("word", "term")]), (False, [])):
        c = T.txt_drop_literal(T.txt_lower("t"))
        c = T.txt_strip_tags(c)
        c = T.txt_strip_mentions(T.txt_strip_rt(c) if rt else c)
        c = T.txt_strip_digits(T.txt_half(T.txt_strip_urls(T.txt_strip_hashtags(c))))
        c = T.txt_strip_punct(T.txt_possessive(T.txt_contractions(c, pairs)))
        both = df.select("t", T.txt_regex_tokens(c).alias("want"), T.clean_preprocess("t", strip_rt=rt, contraction_pairs=pairs).alias("got"))
        assert [r for r in both.collect() if r["want"] != r["got"]] == []
    plan = df.select(T.clean_preprocess("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan
