"""The composite cleaning flows (train/test x English/local language) and
the topic-model text preparation, built from one configurable chain.

Everything up to the term filters is one lazy projection/filter chain with a
single shuffle (keep-last duplicate removal).  The result is checkpointed to
the shared checkpoint folder before the token jobs (split-x, correction,
stem/lemma), each of which is a distinct-token job (see
operators.linguistics).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions import tokens as K
from ..operators import linguistics as G
from ..operators import relational as R
from ..session import cut_lineage


@dataclass(frozen=True)
class CleanConfig:
    language: str | None        # keep only this language (None: keep all)
    train: bool                 # train flows filter, dedupe and drop stop words
    english_dict: bool          # final English replacement step
    english: str = "en"         # label of English in the token-language table
    min_tokens: int = 4
    sentiment_dict: bool = False  # test flows add the sentiment replacements


TRAIN_ENGLISH = CleanConfig(language="en", train=True, english_dict=True)
TRAIN_LOCAL = CleanConfig(language="de", train=True, english_dict=False)
TEST_ENGLISH = CleanConfig(language=None, train=False, english_dict=True, sentiment_dict=True)
TEST_LOCAL = CleanConfig(language=None, train=False, english_dict=False, sentiment_dict=True)


@dataclass
class TokenModels:
    """Corpus-trained token tables (in place of pretrained per-token models)."""
    lang: DataFrame
    en_dict: DataFrame
    local_dict: DataFrame
    proper: DataFrame

    @classmethod
    def fit(cls, posts: DataFrame, text: str = "text", english: str = "en", min_count: int = 5):
        from ..plans.stages import ascii_clean
        c = posts.select("lang", text, K.tok_words(ascii_clean(text)).alias("toks"))
        c = cut_lineage(c)
        lang = cut_lineage(G.token_language_table(c, "toks"))
        en = cut_lineage(G.frequency_dictionary(c.filter(F.col("lang") == english), "toks", min_count))
        lo = cut_lineage(G.frequency_dictionary(c.filter(F.col("lang") != english), "toks", min_count))
        pn = cut_lineage(G.proper_noun_table(c, text))
        return cls(lang, en, lo, pn)


def _stop(c, lex):
    return K.tok_stopwords(c, lex)


def _tokens_of(df, col):
    return df.withColumn("_toks", K.tok_words(col))


def _token_job(df: DataFrame, col: str, table_fn, lex) -> DataFrame:
    # the tokens and both sides of the join back are read from here: without the
    # cut each job would run all the jobs before it three times
    d = cut_lineage(_tokens_of(df, F.col(col)))
    toks = d.select(F.explode("_toks").alias("tok"))
    table = table_fn(toks)
    out = G.resolve_tokens(d, "_toks", table, "_out")
    return out.withColumn(col, F.array_join("_out", " ")).drop("_toks", "_out")


def clean_posts(posts: DataFrame, cfg: CleanConfig, models: TokenModels,
                lex: L.Lexicons = L.DEFAULT, key: str = "row_id") -> DataFrame:
    """posts(row_id, text, lang, username[, batch_no]) -> + textclean,
    textspell, textfin, following the reference order of steps."""
    d = posts
    if cfg.train:
        if cfg.language is not None:
            d = R.filter_language(d, cfg.language)
        d = R.filter_exclude_authors(d, lex.excluded_authors)
    d = d.withColumn("textclean", T.clean_preprocess("text"))
    if cfg.train:
        order = ["batch_no", key] if "batch_no" in d.columns else [key]
        d = R.dedupe_keep_last(d, "textclean", order)
    c = F.col("textclean")
    c = T.txt_squeeze_runs(c)
    c = T.txt_printable(c)
    c = T.txt_dict_replace(c, lex.replacements)
    c = K.tok_map_domain(c)
    d = d.withColumn("textclean", c)
    if cfg.train:
        d = R.filter_include_terms(d, "textclean", lex.include_all())
        d = R.filter_exclude_terms(d, "textclean", lex.exclude_terms)
        c = _stop(F.col("textclean"), lex)
        c = T.txt_laughter(c)
        c = _stop(c, lex)
    else:
        c = T.txt_laughter(F.col("textclean"))
        if cfg.sentiment_dict:
            c = T.txt_dict_replace(c, lex.replacements_senti)
    d = cut_lineage(d.withColumn("textclean", c))

    special = lex.special_words()
    d = _token_job(d, "textclean", lambda t: G.split_prefix_table(t, models.lang, special, cfg.english), lex)
    c = T.txt_dict_replace(F.col("textclean"), lex.replacements)
    if cfg.train:
        c = _stop(c, lex)
    d = d.withColumn("textclean", c)
    d = d.withColumn("textspell", F.col("textclean"))
    d = _token_job(d, "textspell", lambda t: G.correct_table(
        t, models.lang, models.proper, models.en_dict, models.local_dict, special, cfg.english,
        lex.short_forms), lex)
    if cfg.train:
        d = d.withColumn("textspell", _stop(F.col("textspell"), lex))
    d = d.withColumn("textfin", F.col("textspell"))
    d = _token_job(d, "textfin", lambda t: G.stem_lemma_table(
        t, models.lang, models.en_dict, models.local_dict, lex.standard_words(), cfg.english), lex)
    if cfg.english_dict:
        d = d.withColumn("textfin", T.txt_dict_replace(F.col("textfin"), lex.replacements_en))
    if cfg.train:
        d = R.filter_min_tokens(d, "textfin", cfg.min_tokens)
    return d


def topic_prep(df: DataFrame, col: str = "textfin", lex: L.Lexicons = L.DEFAULT) -> DataFrame:
    """Mask rail terms, drop corpus stop words, mask station names."""
    c = K.tok_mask_terms(F.col(col))
    c = K.tok_stopwords_extra(c, lex)
    c = T.txt_mask_phrases(c, lex.stations)
    return df.withColumn(col, c)
