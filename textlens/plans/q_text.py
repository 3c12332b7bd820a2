"""Queries for the string functions of the cleaning chain.

Inputs are the stand-in posts, or the ``noisy`` view (a fixed prefix with
retweet mark, mention, link, hashtag, possessive, contraction, fraction,
markup and a station name) where the generated prose lacks a feature.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions import tokens as K
from ..sources import tables as TB
from . import oracle as O
from . import stages as S
from .catalog import register

V = TB.with_views
LEX = L.DEFAULT


def _one(key, view, spark_fn, sql_expr, out="t", src="text"):
    """Register a per-row text function: SELECT row_id, f(src) AS out."""
    sql = V(f"SELECT row_id, {sql_expr(src)} AS {out} FROM {view}", view)

    def q(spark, sf):
        df = TB.TEXT_VIEWS[view](spark, sf)
        return df.select("row_id", spark_fn(F.col(src)).alias(out))
    q.__name__ = key
    register(key, sql)(q)


_one("clean_preprocess", "tweets", T.clean_preprocess, O.clean_preprocess, out="textclean")
_one("txt_lower", "noisy", T.txt_lower, lambda e: f"lower({e})")
_one("txt_drop_literal", "noisy", T.txt_drop_literal, lambda e: f"replace({e}, '{{html}}', '')")
_one("txt_strip_tags", "noisy", T.txt_strip_tags, lambda e: O.rx(e, r"<[^\n]*?>", ""))
_one("txt_strip_rt", "noisy", T.txt_strip_rt,
     lambda e: O.rx(e, rf"^RT[{O.WS}]+", ""))
_one("txt_strip_mentions", "noisy", T.txt_strip_mentions, lambda e: O.rx(e, rf"@{O.NOT_WS_RUN}", ""))
_one("txt_strip_hashtags", "noisy", T.txt_strip_hashtags, lambda e: O.rx(e, rf"#{O.NOT_WS_RUN}", ""))
_one("txt_strip_urls", "noisy", T.txt_strip_urls,
     lambda e: O.rx(O.rx(O.rx(e, rf"http{O.NOT_WS_RUN}", ""), rf"pic[^\n]twitter[^\n]com[^{O.WS}]+", ""),
                    rf"twitter[^\n]com[^{O.WS}]+", ""))
_one("txt_half", "noisy", T.txt_half, lambda e: f"replace({e}, '½', '.5')")
_one("txt_strip_digits", "tweets", T.txt_strip_digits, lambda e: O.rx(e, "[0-9]+", ""))
_one("txt_contractions", "noisy", lambda c: T.txt_contractions(T.txt_lower(c)),
     lambda e: O.dict_replace(f"lower({e})", L.CONTRACTIONS))
_one("txt_possessive", "noisy", T.txt_possessive, lambda e: O.rx(e, rf"([{O.W}]+)'s", r"\1"))
_one("txt_strip_punct", "tweets", T.txt_strip_punct, lambda e: O.rx(e, rf"[^{O.W}{O.WS}]", " "))
_one("txt_regex_tokens", "tweets", T.txt_regex_tokens, O.regex_tokens)

# steps that run on preprocessed text
_one("txt_squeeze_runs", "tweets", lambda c: T.txt_squeeze_runs(T.clean_preprocess(c)),
     lambda e: O.squeeze_runs(O.clean_preprocess(e)))
_one("txt_printable", "tweets", lambda c: T.txt_printable(T.clean_preprocess(c)),
     lambda e: O.printable(O.clean_preprocess(e)))
_one("txt_dict_replace", "tweets", lambda c: T.txt_dict_replace(S.ascii_clean(c), LEX.replacements),
     lambda e: O.dict_replace(S.ascii_clean_sql(e), LEX.replacements))
_one("txt_dict_replace_english", "tweets",
     lambda c: T.txt_dict_replace(S.ascii_clean(c), LEX.replacements_en),
     lambda e: O.dict_replace(S.ascii_clean_sql(e), LEX.replacements_en))
_one("txt_dict_replace_sentiment", "tweets",
     lambda c: T.txt_dict_replace(S.ascii_clean(c), LEX.replacements_senti),
     lambda e: O.dict_replace(S.ascii_clean_sql(e), LEX.replacements_senti))
_one("tok_map_domain", "tweets", lambda c: K.tok_map_domain(S.ascii_clean(c)),
     lambda e: O.map_domain(S.ascii_clean_sql(e)))
_one("txt_laughter", "tweets", lambda c: T.txt_laughter(S.ascii_clean(c)),
     lambda e: O.laughter(S.ascii_clean_sql(e)))
_one("tok_mask_terms", "tweets", lambda c: K.tok_mask_terms(S.basic(T.clean_preprocess(c))),
     lambda e: O.mask_terms(S.basic_sql(O.clean_preprocess(e))))
_one("txt_mask_phrases", "noisy", lambda c: T.txt_mask_phrases(S.ascii_clean(c)),
     lambda e: O.mask_phrases(S.ascii_clean_sql(e)))
_one("tok_stopwords", "tweets", lambda c: K.tok_stopwords(S.ascii_clean(c)),
     lambda e: O.stopwords(S.ascii_clean_sql(e)))
_one("tok_stopwords_extra", "tweets", lambda c: K.tok_stopwords_extra(S.laugh_clean(c)),
     lambda e: O.join(O.remove(O.words(S.laugh_clean_sql(e)), LEX.topic_stop)))
_one("tok_words", "tweets", lambda c: K.tok_join(K.tok_words(S.ascii_clean(c))),
     lambda e: O.join(O.words(S.ascii_clean_sql(e))))
_one("tok_split_ws", "tweets", lambda c: F.size(K.tok_split_ws(c)).cast("long"),
     lambda e: f"CAST(len({O.split_ws(e)}) AS BIGINT)", out="n")
_one("tok_count", "tweets", lambda c: K.tok_count(S.ascii_clean(c)).cast("long"),
     lambda e: f"CAST(len({O.words(S.ascii_clean_sql(e))}) AS BIGINT)", out="n_tokens")
_one("tok_sentences", "tweets", lambda c: K.tok_join(K.tok_sentences(c)),
     lambda e: O.join(f"flatten(list_transform(string_split({O.rx(e, '([.!?])[' + O.WS + ']+', chr(92) + '1' + chr(10))}, "
                      f"chr(10)), lambda s: {O.tokens('s')}))"))


# ------------------------------------------------------------ streaming ----

@register("stream_clean_preprocess", V(f"SELECT row_id, {O.clean_preprocess('text')} AS textclean FROM tweets", "tweets"))
def stream_clean_preprocess(spark, sf):
    """preprocess() applied by a Structured Streaming query over the posts'
    parquet files; the sink is read back as a table."""
    from ..streaming.clean_stream import clean_stream, run_to_parquet
    out = run_to_parquet(clean_stream(spark, sf))
    return spark.read.parquet(out).select("row_id", "textclean")
