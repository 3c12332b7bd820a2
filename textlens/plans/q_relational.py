"""Queries for sources/sinks, projections, filters, joins, aggregations,
duplicates and set operations (SURVEY 2.1-2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions import tokens as K
from ..operators import relational as R
from ..session import scratch_path
from ..sources import files as FS
from ..sources import tables as TB
from . import oracle as O
from . import stages as S
from .catalog import register

V = TB.with_views
q = O.q

# ------------------------------------------------------------- 2.1 I/O ----

TWEET_SCHEMA = "row_id bigint, text string, lang string, username string"


@register("src_csv", V("SELECT row_id, text, lang, username FROM tweets", "tweets"))
def src_csv(spark, sf):
    p = scratch_path(spark, "src_csv")
    FS.write_csv(TB.tweets(spark, sf), p)
    from pyspark.sql.types import _parse_datatype_string
    return FS.read_csv(spark, p, _parse_datatype_string(TWEET_SCHEMA))


@register("sink_csv", V(f"SELECT row_id, {O.clean_preprocess('text')} AS textclean FROM tweets", "tweets"))
def sink_csv(spark, sf):
    p = scratch_path(spark, "sink_csv")
    out = TB.texts(spark, sf).select("row_id", T.clean_preprocess("text").alias("textclean"))
    FS.write_csv(out, p)
    from pyspark.sql.types import _parse_datatype_string
    back = FS.read_csv(spark, p, _parse_datatype_string("row_id bigint, textclean string"))
    # an empty cleaned text is written as an empty quoted field and read back as ""
    return back.select("row_id", F.coalesce("textclean", F.lit("")).alias("textclean"))


@register("src_records", V("SELECT row_id, text, lang, username FROM tweets", "tweets"))
def src_records(spark, sf):
    p = scratch_path(spark, "src_records")
    FS.write_records(TB.tweets(spark, sf), p)
    from pyspark.sql.types import _parse_datatype_string
    return FS.read_records(spark, p, _parse_datatype_string(TWEET_SCHEMA))


@register("lex_list", "SELECT DISTINCT source AS term FROM documents WHERE source IS NOT NULL")
def lex_list(spark, sf):
    """A list lexicon (", "-separated) written from the sources and read back."""
    p = scratch_path(spark, "lex_list")
    FS.write_list_lexicon(TB.table(spark, sf, "documents"), "source", p)
    return FS.read_list_lexicon(spark, p).select("term").distinct()


@register("lex_pairs", (
    "SELECT source AS key, arg_max(lang, doc_id) AS val FROM documents "
    "WHERE source IS NOT NULL GROUP BY source"))
def lex_pairs(spark, sf):
    """A map lexicon of ``source, lang`` lines in row order, written over
    several part files; repeated keys take their last value."""
    p = scratch_path(spark, "lex_pairs")
    d = TB.table(spark, sf, "documents").dropna(subset=["source"])
    d = d.select("doc_id", F.concat_ws(", ", "source", "lang").alias("line"))
    FS.write_lines_in_order(d, "line", "doc_id", p, n_files=4)
    return FS.read_pair_lexicon(spark, p).select("key", "val")


# ------------------------------------------------------- 2.2 projections --

@register("project_columns", V("SELECT row_id, text, sentiment FROM labelled", "labelled"))
def project_columns(spark, sf):
    return R.project_columns(TB.labelled(spark, sf), ["text", "sentiment"])


@register("derive_column", V("SELECT row_id, CAST(length(text) AS BIGINT) AS text_len, "
                             "upper(lang) AS lang_code FROM tweets", "tweets"))
def derive_column(spark, sf):
    t = TB.tweets(spark, sf)
    return t.select("row_id", F.length("text").cast("long").alias("text_len"),
                    F.upper("lang").alias("lang_code"))


@register("cast_text", (
    "SELECT l.doc_id AS row_id, coalesce(CAST(d.text AS VARCHAR), 'nan') AS text "
    "FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id"))
def cast_text(spark, sf):
    lab = TB.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    d = TB.tweets(spark, sf).select("row_id", "text")
    return R.cast_text(lab.join(d, "row_id", "left"), "text", parity=True)


@register("parse_timestamp", (
    "SELECT event_id, strftime(CAST(CAST(ts AS VARCHAR) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts_text, "
    "CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events"))
def parse_timestamp(spark, sf):
    e = TB.table(spark, sf, "events")
    parsed = R.parse_timestamp(F.col("ts").cast("string"))
    return e.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
                    F.to_date(parsed).cast("string").alias("day"))


@register("filter_period", (
    "SELECT event_id, user_id, event_type FROM events "
    "WHERE ts > TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'"))
def filter_period(spark, sf):
    e = TB.table(spark, sf, "events")
    out = R.filter_period(e, "ts", F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"),
                          F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return out.select("event_id", "user_id", "event_type")


@register("filter_language", V("SELECT row_id, username FROM tweets WHERE lang = 'en'", "tweets"))
def filter_language(spark, sf):
    return R.filter_language(TB.tweets(spark, sf), "en").select("row_id", "username")


AUTHORS = L.EXCLUDED_AUTHORS + ["src3", "src7"]


@register("filter_exclude_authors", V(
    f"SELECT row_id, username FROM tweets WHERE coalesce(NOT {O.in_list('username', AUTHORS)}, TRUE)",
    "tweets"))
def filter_exclude_authors(spark, sf):
    return R.filter_exclude_authors(TB.tweets(spark, sf), AUTHORS).select("row_id", "username")


def _basic_spark(spark, sf):
    t = TB.texts(spark, sf)
    return t.select("row_id", S.basic(T.clean_preprocess("text")).alias("textclean"))


def _basic_sql():
    return f"SELECT row_id, {S.basic_sql(O.clean_preprocess('text'))} AS textclean FROM tweets"


@register("filter_include_terms", V(
    f"SELECT row_id, textclean FROM ({_basic_sql()}) b WHERE {O.include('textclean', L.DEFAULT.include_all())}",
    "tweets"))
def filter_include_terms(spark, sf):
    return R.filter_include_terms(_basic_spark(spark, sf), "textclean", L.DEFAULT.include_all())


@register("filter_exclude_terms", V(
    f"SELECT row_id FROM ({_basic_sql()}) b WHERE NOT {O.include('textclean', L.EXCLUDE_TERMS)}",
    "tweets"))
def filter_exclude_terms(spark, sf):
    return R.filter_exclude_terms(_basic_spark(spark, sf), "textclean", L.EXCLUDE_TERMS).select("row_id")


@register("filter_min_tokens", V(
    f"SELECT row_id, CAST(len({O.words('c')}) AS BIGINT) AS n_tokens FROM "
    f"(SELECT row_id, {O.clean_preprocess('text')} AS c FROM tweets) WHERE len({O.words('c')}) >= 4",
    "tweets"))
def filter_min_tokens(spark, sf):
    t = TB.texts(spark, sf).select("row_id", T.clean_preprocess("text").alias("c"))
    return R.filter_min_tokens(t, "c", 4).select("row_id", K.tok_count("c").cast("long").alias("n_tokens"))


@register("filter_not_label", V(
    "SELECT row_id, sentiment FROM labelled WHERE sentiment IS DISTINCT FROM 'positive'", "labelled"))
def filter_not_label(spark, sf):
    return R.filter_not_label(TB.labelled(spark, sf), "sentiment", "positive").select("row_id", "sentiment")


@register("filter_event_rows", V(
    "SELECT row_id, sentiment FROM labelled WHERE sentiment IS DISTINCT FROM 'positive' AND target = 'yes'",
    "labelled"))
def filter_event_rows(spark, sf):
    d = R.filter_not_label(TB.labelled(spark, sf), "sentiment", "positive")
    return R.filter_event_rows(d, "target", "yes").select("row_id", "sentiment")


@register("head_n", V("SELECT row_id, username FROM tweets ORDER BY row_id LIMIT 8", "tweets"))
def head_n(spark, sf):
    return R.head_n(TB.tweets(spark, sf).select("row_id", "username"), 8)


@register("sample_n", V(
    "SELECT row_id FROM tweets ORDER BY md5(CAST(row_id AS VARCHAR) || ':6'), row_id LIMIT 6", "tweets"))
def sample_n(spark, sf):
    return R.sample_n(TB.tweets(spark, sf).select("row_id"), 6, seed=6)


# ----------------------------------------------------------------- joins --

def _toks_sql():
    return (f"SELECT row_id, unnest({O.words('c')}) AS tok FROM "
            f"(SELECT row_id, {S.ascii_clean_sql('text')} AS c FROM tweets)")


def _toks_spark(spark, sf):
    t = TB.texts(spark, sf).select("row_id", K.tok_words(S.ascii_clean("text")).alias("toks"))
    return t.select("row_id", F.explode("toks").alias("tok"))


@register("join_token_lexicon", V(
    f"SELECT row_id, CAST(count(*) AS BIGINT) AS n_tokens, "
    f"CAST(count(*) FILTER (WHERE {O.in_list('tok', L.DEFAULT.stopwords())}) AS BIGINT) AS n_stop "
    f"FROM ({_toks_sql()}) GROUP BY row_id", "tweets"))
def join_token_lexicon(spark, sf):
    """Token membership in the stop-word lexicon by an equi-join (AQE
    broadcasts the lexicon side once it is measured small)."""
    toks = _toks_spark(spark, sf)
    lex = spark.createDataFrame([(w, True) for w in L.DEFAULT.stopwords()], "tok string, is_stop boolean")
    j = R.join_token_lexicon(toks, lex, "left")
    return j.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count(F.when(F.col("is_stop"), 1)).alias("n_stop"))


# ---------------------------------------------------------- aggregations --

@register("group_size", V("SELECT lang, count(*) AS n FROM tweets WHERE lang IS NOT NULL GROUP BY lang", "tweets"))
def group_size(spark, sf):
    return R.group_size(TB.tweets(spark, sf), "lang")


SENTIMENTS = ["negative", "neutral", "positive"]


@register("crosstab", V(
    "SELECT target, " + ", ".join(
        f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in SENTIMENTS)
    + " FROM labelled WHERE target IS NOT NULL AND sentiment IS NOT NULL GROUP BY target", "labelled"))
def crosstab(spark, sf):
    return R.crosstab(TB.labelled(spark, sf), "target", "sentiment", SENTIMENTS)


@register("describe_categorical", V(
    "SELECT column_name AS \"column\", CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS \"unique\", "
    "arg_min(value, (-n, value)) AS top, CAST(max(n) AS BIGINT) AS freq FROM ("
    "SELECT 'target' AS column_name, target AS value, count(*) AS n FROM labelled WHERE target IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'sentiment', sentiment, count(*) FROM labelled WHERE sentiment IS NOT NULL GROUP BY 2"
    ") GROUP BY column_name", "labelled"))
def describe_categorical(spark, sf):
    return R.describe_categorical(TB.labelled(spark, sf), ["target", "sentiment"])


@register("null_counts", V(
    "SELECT col AS \"column\", CAST(n AS BIGINT) AS n_missing FROM (SELECT "
    "count(*) FILTER (WHERE t.row_id IS NULL) AS row_id, count(*) FILTER (WHERE t.text IS NULL) AS text, "
    "count(*) FILTER (WHERE t.lang IS NULL) AS lang, count(*) FILTER (WHERE t.username IS NULL) AS username, "
    "count(*) FILTER (WHERE l.quality IS NULL) AS quality, count(*) FILTER (WHERE l.toxic IS NULL) AS toxic "
    "FROM tweets t LEFT JOIN labels l ON t.row_id = l.doc_id) "
    "UNPIVOT (n FOR col IN (row_id, text, lang, username, quality, toxic))", "tweets"))
def null_counts(spark, sf):
    t = TB.tweets(spark, sf)
    lab = TB.table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    return R.null_counts(t.join(lab, "row_id", "left").select(
        "row_id", "text", "lang", "username", "quality", "toxic"))


@register("table_profile", V(
    "SELECT CAST(p.position AS BIGINT) AS position, p.column_name AS \"column\", p.dtype, n.n_rows FROM "
    "(VALUES (0, 'row_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'username', 'string')) "
    "p(position, column_name, dtype), (SELECT count(*) AS n_rows FROM tweets) n", "tweets"))
def table_profile(spark, sf):
    return R.table_profile(TB.tweets(spark, sf))


@register("vocab_size", V(f"SELECT CAST(count(DISTINCT tok) AS BIGINT) AS n_terms FROM ({_toks_sql()})", "tweets"))
def vocab_size(spark, sf):
    t = TB.texts(spark, sf).select(K.tok_words(S.ascii_clean("text")).alias("toks"))
    return R.vocab_size(t, "toks")


@register("distinct_tokens", (
    "SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS token FROM benchmark) "
    "WHERE token <> ''"))
def distinct_tokens(spark, sf):
    lex = TB.table(spark, sf, "benchmark").select(F.col("text").alias("term"))
    return R.distinct_tokens(lex, "term")


# ----------------------------------------------------------- duplicates --

@register("dedupe_keep_last", V(
    f"SELECT arg_max(row_id, row_id) AS row_id, textclean FROM "
    f"(SELECT row_id, {O.clean_preprocess('text')} AS textclean FROM tweets) GROUP BY textclean", "tweets"))
def dedupe_keep_last(spark, sf):
    t = TB.texts(spark, sf).select("row_id", T.clean_preprocess("text").alias("textclean"))
    return R.dedupe_keep_last(t, "textclean", "row_id").select("row_id", "textclean")


# -------------------------------------------------------------- set ops --

@register("union_periods", (
    "SELECT o_custkey, arg_max(o_orderkey, (batch_no, o_orderkey)) AS o_orderkey, "
    "CAST(arg_max(batch_no, (batch_no, o_orderkey)) AS INTEGER) AS batch_no FROM ("
    "SELECT o_custkey, o_orderkey, 0 AS batch_no FROM orders WHERE year(o_orderdate) = 1996 "
    "UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE year(o_orderdate) = 1995) "
    "GROUP BY o_custkey"))
def union_periods(spark, sf):
    """Two periods stacked (1996 first, then 1995), then one row per
    customer: the last in (batch_no, row) order."""
    o = TB.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    y = F.year("o_orderdate")
    a = o.filter(y == 1996).drop("o_orderdate")
    b = o.filter(y == 1995).drop("o_orderdate")
    u = R.union_periods([a, b])
    return R.dedupe_keep_last(u, "o_custkey", ["batch_no", "o_orderkey"])


@register("lexicon_union", V(
    "SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS term FROM benchmark "
    "UNION ALL SELECT username FROM tweets) WHERE term <> ''", "tweets"))
def lexicon_union(spark, sf):
    a = R.distinct_tokens(TB.table(spark, sf, "benchmark").select(F.col("text").alias("term")), "term") \
        .withColumnRenamed("token", "term")
    b = TB.tweets(spark, sf).select(F.col("username").alias("term")).filter(F.col("term") != "")
    return R.lexicon_union(a, b)


@register("lexicon_except", (
    "SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark) "
    f"WHERE term <> '' AND NOT {O.in_list('term', L.KEEP_WORDS)}"))
def lexicon_except(spark, sf):
    """Candidate words minus the keep-list."""
    words = TB.table(spark, sf, "benchmark").select(
        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter(F.col("term") != "")
    keep = spark.createDataFrame([(w,) for w in L.KEEP_WORDS], "term string")
    return R.lexicon_except(words, keep, "term")


# ------------------------------------------------------ flagship slice ----

@register("clean_dedupe_by_lang", V(
    f"SELECT lang, count(*) AS n FROM (SELECT arg_max(lang, row_id) AS lang FROM "
    f"(SELECT row_id, lang, {O.clean_preprocess('text')} AS textclean FROM tweets) GROUP BY textclean) "
    f"WHERE lang IS NOT NULL GROUP BY lang", "tweets"))
def clean_dedupe_by_lang(spark, sf):
    """Minimum slice: preprocess, keep the last copy of each cleaned text,
    count rows per language."""
    t = TB.texts(spark, sf).select("row_id", "lang", T.clean_preprocess("text").alias("textclean"))
    return R.group_size(R.dedupe_keep_last(t, "textclean", "row_id"), "lang")
