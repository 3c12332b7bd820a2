"""Table-driven tests of the cleaning column functions (FIXTURES.md 4)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlens.functions import text as T
from textlens.functions import tokens as K


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


PREPROCESS = [
    ("RT @user Hello", "rt hello"),
    ("<b>Late</b> again", "late again"),
    ("a<b\nc>d", "a b c d"),
    ("see http://t.co/x1 now", "see now"),
    ("pic.twitter.com/ab twitter.com/z ok", "ok"),
    ("waited 2½ hours", "waited hours"),
    ("mail me a@b.com #fail ok", "mail me a ok"),
    ("the driver's seat", "the driver seat"),
    ("snake_case {html}x", "snake_case x"),
    ("x²  café — naïve", "x² café naïve"),
    ("", ""),
]


def test_clean_preprocess(spark):
    got = run(spark, lambda c: T.clean_preprocess(c, contractions=False), [a for a, _ in PREPROCESS])
    assert got == [b for _, b in PREPROCESS]


def test_contractions(spark):
    assert run(spark, T.clean_preprocess, ["I can't go, don't wait"]) == ["i cannot go do not wait"]


def test_squeeze_printable(spark):
    assert run(spark, T.txt_squeeze_runs, ["coooool", "aabb", "aaa  bbb"]) == ["cool", "aabb", "aa  bb"]
    assert run(spark, T.txt_printable, ["café 中文 ok", "a\tb c"]) == ["caf  ok", "a\tbc"]


def test_laughter(spark):
    got = run(spark, T.txt_laughter, ["hahaha so late", "lol ok", "kkkk", "kaki sakit", "oh akhir", "all"])
    assert got == ["laugh so late", "laugh ok", "laugh", "laugh sakit", "oh akhir", "all"]


def test_dict_replace_no_cascade_whole_word(spark):
    lex = [("st", "station"), ("tak boleh", "cannot"), ("boleh", "can"), ("cannot", "no")]
    got = run(spark, lambda c: T.txt_dict_replace(c, lex), ["st tak boleh boleh", "best cannot", "", None])
    assert got == ["station cannot can", "best no", "", None]


def test_dict_replace_first_key_wins(spark):
    # alternation order decides, not key length
    lex = [("a", "X"), ("a b", "Y")]
    assert run(spark, lambda c: T.txt_dict_replace(c, lex), ["a b"]) == ["X b"]
    lex = [("a b", "Y"), ("a", "X")]
    assert run(spark, lambda c: T.txt_dict_replace(c, lex), ["a b a"]) == ["Y X"]


def test_empty_lexicon_is_noop(spark):
    assert run(spark, lambda c: T.txt_dict_replace(c, []), ["a b"]) == ["a b"]


def test_tok_words_split_table(spark):
    got = run(spark, lambda c: K.tok_join(K.tok_words(c)), ["i Cannot gonna go  now"])
    assert got == ["i Can not gon na go now"]


def test_domain_map(spark):
    got = run(spark, K.tok_map_domain, ["stn rel koc lrts monorail mrl rapidkl bas lrt brt x"])
    assert got == ["station train carriage lrt Monorail Monorail Rapidkl bus Lrt Brt x"]


def test_mask_terms_keeps_gaps(spark):
    assert run(spark, K.tok_mask_terms, ["a Lrt b"]) == ["a  b"]


def test_stopwords_case_sensitive(spark):
    assert run(spark, K.tok_stopwords, ["The the cat is here"]) == ["The cat here"]


TEXT = st.text(alphabet=st.sampled_from(list("aab  hoel\tkx.é!")), max_size=40)


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_idempotent_steps(spark, values):
    for fn in (T.txt_squeeze_runs, T.txt_printable, K.tok_stopwords):
        once = run(spark, fn, values)
        assert run(spark, fn, once) == once


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aaeiouhhhkklloox _.")), max_size=16))
def test_linear_laughter_patterns_equal_reference(s):
    """The linear-time patterns replace exactly what the reference patterns
    replace (checked with Python's re, the reference engine)."""
    import re

    from textlens import lexicons as L
    from textlens.functions.patterns import LAUGH_LINEAR
    for orig, lin in zip(L.LAUGH_PATTERNS, LAUGH_LINEAR):
        assert re.sub(orig, "laugh", s) == re.sub(lin, "laugh", s)
