"""Column functions of the cleaning chain.

Every function takes and returns a ``Column`` built only from Spark's native
expressions (no Python UDF), so a whole chain compiles into one generated
projection with no shuffle.  String-in/string-out functions keep the
reference's habit of re-joining tokens with single spaces; ``*_tokens``
variants return ``ARRAY<STRING>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .patterns import JAVA_TOKEN, JAVA_W, LAUGH_LINEAR, NOT_WS_RUN, WS, escape, word_trie


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rx(c, pattern: str, repl: str) -> Column:
    return F.regexp_replace(_c(c), F.lit(pattern), F.lit(repl))


# --------------------------------------------------------------------------
# single steps of preprocess(), in order
# --------------------------------------------------------------------------

def txt_lower(c) -> Column:
    return F.lower(_c(c))


def txt_drop_literal(c, literal: str = "{html}") -> Column:
    return F.replace(_c(c), F.lit(literal), F.lit(""))


def txt_strip_tags(c) -> Column:
    # Python's '.' stops only at \n; Java's stops at more line ends.
    return _rx(c, r"<[^\n]*?>", "")


def txt_strip_rt(c) -> Column:
    return _rx(c, rf"^RT[{WS}]+", "")


def txt_strip_mentions(c) -> Column:
    return _rx(c, rf"@{NOT_WS_RUN}", "")


def txt_strip_hashtags(c) -> Column:
    return _rx(c, rf"#{NOT_WS_RUN}", "")


def txt_strip_urls(c) -> Column:
    # dots are unescaped in the reference patterns (any char but newline)
    c = _rx(c, rf"http{NOT_WS_RUN}", "")
    c = _rx(c, rf"pic[^\n]twitter[^\n]com[^{WS}]+", "")
    return _rx(c, rf"twitter[^\n]com[^{WS}]+", "")


def txt_half(c) -> Column:
    return F.replace(_c(c), F.lit("½"), F.lit(".5"))


def txt_strip_digits(c) -> Column:
    return _rx(c, r"[0-9]+", "")


def txt_possessive(c) -> Column:
    # one letter before the mark stands for its whole run
    return _rx(c, rf"([{JAVA_W}])'s", "$1")


def txt_strip_punct(c) -> Column:
    return _rx(c, rf"[^{JAVA_W}{WS}]", " ")


def txt_words_only(c) -> Column:
    """``txt_regex_tokens(txt_strip_punct(c))`` in one pass: without punctuation
    the tokens are the runs of word characters."""
    return F.array_join(F.regexp_extract_all(_c(c), F.lit(rf"[{JAVA_W}]+"), F.lit(0)), " ")


def regex_tokens(c) -> Column:
    """``[\\w']+|[^\\w\\s]+`` matches, as an array."""
    return F.regexp_extract_all(_c(c), F.lit(JAVA_TOKEN), F.lit(0))


def txt_regex_tokens(c) -> Column:
    return F.array_join(regex_tokens(c), " ")


# --------------------------------------------------------------------------
# dictionary replacement (the "weave")
# --------------------------------------------------------------------------

def map_literal(pairs) -> Column:
    pairs = L.dedupe_pairs(pairs)
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]),
                             F.array(*[F.lit(v) for _, v in pairs]))


def let(c, body) -> Column:
    """Evaluate ``c`` once and pass it to ``body`` (a lambda over Column).

    Higher-order functions run interpreted, so an input referenced twice
    inside one would be computed twice; binding it through a one-element
    ``transform`` computes it once however often ``body`` uses it."""
    return F.transform(F.array(_c(c)), body)[0]


#: Set around the matches of a replacement.
MARK = "\x01"


def txt_dict_replace(c, pairs) -> Column:
    """Whole-word replacement by an ordered alternation, one pass.

    At each position the first lexicon key (in lexicon order) that matches as
    a whole word wins, and replaced text is never re-scanned.  Built natively:
    one ``regexp_replace`` sets marks around the matches, ``split`` on the mark
    gives gaps and matches in turn, and both are woven back together.  (``split``
    compiles its pattern for each row, so it gets no long one; it does only in
    a text that holds the mark itself.)
    """
    pairs = L.dedupe_pairs(pairs)
    if not pairs:
        return _c(c)
    pat = word_trie([k for k, _ in pairs])
    m = map_literal(pairs)

    def weave(s):
        parts = F.split(F.regexp_replace(s, F.lit(pat), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        woven = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(m, x), x)).otherwise(x))
        return F.when(F.contains(s, F.lit(MARK)), by_gaps(s)).otherwise(F.array_join(woven, ""))

    def by_gaps(s):
        gaps = F.split(s, pat, -1)
        hits = F.transform(F.regexp_extract_all(s, F.lit(pat), F.lit(0)),
                           lambda h: F.coalesce(F.try_element_at(m, h), h))
        woven = F.zip_with(gaps, F.concat(hits, F.array(F.lit(""))),
                           lambda g, r: F.concat(F.coalesce(g, F.lit("")), F.coalesce(r, F.lit(""))))
        return F.array_join(woven, "")
    return let(c, weave)


def txt_contractions(c, pairs=None) -> Column:
    return txt_dict_replace(c, pairs if pairs is not None else L.CONTRACTIONS)


def where_held(c, marks, body) -> Column:
    """``body`` of the texts that hold one of ``marks``; the others, which it
    would not change, are passed on after a plain search."""
    def held(s):
        found = F.contains(s, F.lit(marks[0]))
        for m in marks[1:]:
            found = found | F.contains(s, F.lit(m))
        return F.when(found, body(s)).otherwise(s)
    return let(c, held)


# --------------------------------------------------------------------------
# the composite preprocess()
# --------------------------------------------------------------------------

def clean_preprocess(c, contractions=True, strip_rt=False, contraction_pairs=None) -> Column:
    c = txt_lower(c)
    c = txt_drop_literal(c)

    def strip_marked(s):
        s = txt_strip_tags(s)
        if strip_rt:
            s = txt_strip_rt(s)
        return txt_strip_urls(txt_strip_hashtags(txt_strip_mentions(s)))
    # each of these patterns holds one of the marks
    c = where_held(c, ["<", "@", "#", "http", "twitter", *(["RT"] if strip_rt else [])], strip_marked)
    c = txt_half(c)
    c = txt_strip_digits(c)
    pairs = L.CONTRACTIONS if contraction_pairs is None else contraction_pairs
    if contractions and not all("'" in k for k, _ in pairs):
        c = txt_possessive(txt_contractions(c, pairs))
    else:
        c = where_held(c, ["'"], lambda s: txt_possessive(txt_contractions(s, pairs) if contractions else s))
    return txt_words_only(c)


# --------------------------------------------------------------------------
# later string steps
# --------------------------------------------------------------------------

def txt_squeeze_runs(c) -> Column:
    """Three or more of one character (not newline) become two."""
    return _rx(c, r"([^\n])\1{2,}", "$1$1")


def txt_printable(c) -> Column:
    """Keep Python's ``string.printable`` characters only."""
    return _rx(c, r"[^\x20-\x7E\t\n\r\x0B\x0C]", "")


def txt_laughter(c) -> Column:
    for p in LAUGH_LINEAR:
        c = _rx(c, p, "laugh")
    return txt_regex_tokens(c)


def txt_mask_phrases(c, phrases=None) -> Column:
    phrases = L.STATION_NAMES if phrases is None else phrases
    if phrases:
        c = _rx(c, word_trie(phrases), "")
    return txt_regex_tokens(c)


def txt_include(c, terms) -> Column:
    """Substring match of any term (regex alternation, case-sensitive)."""
    return _c(c).rlike("|".join(escape(t) for t in terms))
