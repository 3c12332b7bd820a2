"""Token-array column functions.

Tokens stay ``ARRAY<STRING>`` between steps; higher-order functions
(``filter``/``transform``/``aggregate``) keep the work inside generated code.
Membership tests use ``isin`` which the optimizer turns into a hashed set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .patterns import TOKEN, WS, WS_RUN
from .text import _c, map_literal, regex_tokens


def tok_split_ws(c) -> Column:
    """``str.split()``: whitespace runs, empties dropped."""
    return F.filter(F.split(_c(c), WS_RUN, -1), lambda x: x != "")


def tok_words(c, split_table: bool = True) -> Column:
    """Word tokenizer on cleaned text: whitespace split, plus the fixed
    split of ``cannot, gimme, gonna, gotta, lemme, wanna`` after three letters
    (case-insensitive), as the treebank tokenizer does."""
    toks = tok_split_ws(c)
    if not split_table:
        return toks
    return F.flatten(F.transform(
        toks,
        lambda t: F.when(F.lower(t).isin(L.NLTK_SPLIT_WORDS),
                         F.array(F.substring(t, 1, 3), F.substring(t, 4, 1 << 20)))
        .otherwise(F.array(t))))


def tok_count(c) -> Column:
    return F.size(tok_words(c))


def tok_join(arr) -> Column:
    return F.array_join(arr, " ")


def tok_remove(arr, words) -> Column:
    """Drop tokens in ``words``, keeping order and repeats (case-sensitive)."""
    words = list(dict.fromkeys(words))
    if not words:
        return arr
    return F.filter(arr, lambda x: ~x.isin(words))


def tok_stopwords(c, lex: L.Lexicons = L.DEFAULT) -> Column:
    """remove_stopwords(): word-tokenize, drop stop words, re-join."""
    return tok_join(tok_remove(tok_words(c), lex.stopwords()))


def tok_stopwords_extra(c, lex: L.Lexicons = L.DEFAULT) -> Column:
    return tok_join(tok_remove(tok_words(c), lex.topic_stop))


def tok_map(arr, pairs) -> Column:
    m = map_literal(pairs)
    # the map is searched key by key, so only for the words it holds
    keys = [k for k, _ in pairs]
    return F.transform(arr, lambda t: F.when(t.isin(keys), F.coalesce(F.try_element_at(m, t), t)).otherwise(t))


def tok_map_domain(c) -> Column:
    """standardize2(): regex-tokenize, map rail words, re-join."""
    return tok_join(tok_map(regex_tokens(c), L.domain_pairs()))


def tok_mask_terms(c, terms=None) -> Column:
    """standardize4(): masked tokens become empty strings; the re-join then
    leaves double spaces exactly as the reference does."""
    terms = L.TOPIC_MASK_TOKENS if terms is None else terms
    return tok_join(F.transform(regex_tokens(c),
                                lambda t: F.when(t.isin(terms), F.lit("")).otherwise(t)))


def tok_sentences(c) -> Column:
    """Sentence split (an end mark followed by whitespace, or a line end),
    then the word tokens of each sentence, flattened in order."""
    marked = F.regexp_replace(_c(c), F.lit(rf"([.!?])[{WS}]+"), F.lit("$1\n"))
    sents = F.split(marked, "\n", -1)
    return F.flatten(F.transform(sents, lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))))
