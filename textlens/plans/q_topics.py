"""Queries for topic modelling.

Topic corpus: English posts, standardised, stop words removed, then the
topic preparation (mask rail terms, corpus stop words, station names).
Counting operators (phrases, dictionary, bags, coherence on fixed topics,
relevance on a fixed matrix) have SQL oracles; fitted models are checked by
row counts here and by invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions import tokens as K
from ..operators import topic_models as TM
from ..operators import topics as TP
from ..session import cut_lineage, scratch_path
from ..sources import files as FS
from ..sources import tables as TB
from . import oracle as O
from . import stages as S
from .catalog import register

LEX = L.DEFAULT
R6 = 6


def topic_corpus(spark, sf):
    return cut_lineage(TB.texts(spark, sf, "en").select("row_id", topic_tokens("text").alias("toks")))


def topic_tokens(text):
    """The tokens of a post as the topic models see them."""
    c = S.basic(T.clean_preprocess(text))
    c = K.tok_stopwords(c, LEX)
    c = K.tok_mask_terms(c)
    c = K.tok_stopwords_extra(c, LEX)
    c = T.txt_mask_phrases(c, LEX.stations)
    return K.tok_split_ws(c)


def topic_corpus_sql():
    e = O.stopwords(S.basic_sql(O.clean_preprocess("text")))
    e = O.mask_phrases(O.join(O.remove(O.words(O.mask_terms(e)), LEX.topic_stop)), LEX.stations)
    return (f"tweets AS ({TB.SQL_VIEWS['tweets']}), "
            f"corpus AS (SELECT row_id, {O.split_ws(e)} AS toks FROM tweets WHERE lang = 'en')")


def W(body, *extra):
    return "WITH " + ", ".join([topic_corpus_sql(), *extra]) + " " + body


# ---------------------------------------------------------------- phrases --

PH_UNI = "uni AS (SELECT w, count(*) AS n FROM (SELECT unnest(toks) AS w FROM corpus) GROUP BY w)"
PH_PAIRS = ("pairs AS (SELECT p.a AS a, p.b AS b, count(*) AS n_ab FROM (SELECT unnest(list_transform("
            "range(1, len(toks)), lambda i: {'a': toks[i], 'b': toks[i + 1]})) AS p FROM corpus) GROUP BY 1, 2)")
PH_V = "v AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM pairs) AS V)"


@register("phrase_fit", W(
    f"SELECT p.a, p.b, CAST(p.n_ab AS BIGINT) AS n_ab, round((p.n_ab - {L.PHRASE_MIN_COUNT}) * v.V / (ua.n * ub.n), {R6}) AS score "
    f"FROM pairs p JOIN uni ua ON p.a = ua.w JOIN uni ub ON p.b = ub.w, v "
    f"WHERE (p.n_ab - {L.PHRASE_MIN_COUNT}) * v.V / (ua.n * ub.n) > {L.PHRASE_THRESHOLD}", PH_UNI, PH_PAIRS, PH_V))
def phrase_fit(spark, sf):
    ph = TP.phrase_fit(topic_corpus(spark, sf), "toks")
    return ph.select("a", "b", "n_ab", F.round("score", R6).alias("score"))


@register("phrase_counts", W(
    "SELECT (SELECT count(*) FROM uni) AS n_unigrams, (SELECT count(*) FROM pairs) AS n_pairs, "
    "(SELECT CAST(sum(n_ab) AS BIGINT) FROM pairs) AS n_pair_tokens", PH_UNI, PH_PAIRS))
def phrase_counts(spark, sf):
    uni, pairs = TP.phrase_counts(topic_corpus(spark, sf), "toks")
    u = uni.select(F.lit(True).alias("is_uni"), F.lit(0).cast("long").alias("n_ab"))
    p = pairs.select(F.lit(False).alias("is_uni"), F.col("n_ab").cast("long"))
    return u.unionByName(p).agg(
        F.count_if("is_uni").alias("n_unigrams"), F.count_if(~F.col("is_uni")).alias("n_pairs"),
        F.sum("n_ab").cast("long").alias("n_pair_tokens"))


def _bigrammed(spark, sf):
    """The topic corpus with its phrases merged."""
    c = topic_corpus(spark, sf)
    return cut_lineage(TP.phrase_apply(c, "toks", TP.phrase_fit(c, "toks")))


def _ph_sql(src, pre):
    """CTEs for unigram/pair counts and learned phrases over corpus ``src``."""
    return [f"{pre}uni AS (SELECT w, count(*) AS n FROM (SELECT unnest(toks) AS w FROM {src}) GROUP BY w)",
            f"{pre}pairs AS (SELECT p.a AS a, p.b AS b, count(*) AS n_ab FROM (SELECT unnest(list_transform("
            f"range(1, len(toks)), lambda i: {{'a': toks[i], 'b': toks[i + 1]}})) AS p FROM {src}) GROUP BY 1, 2)",
            f"{pre}v AS (SELECT (SELECT count(*) FROM {pre}uni) + (SELECT count(*) FROM {pre}pairs) AS V)",
            f"{pre}phrases AS (SELECT p.a, p.b, p.n_ab, (p.n_ab - {L.PHRASE_MIN_COUNT}) * v.V / (ua.n * ub.n) AS score "
            f"FROM {pre}pairs p JOIN {pre}uni ua ON p.a = ua.w JOIN {pre}uni ub ON p.b = ub.w, {pre}v v "
            f"WHERE (p.n_ab - {L.PHRASE_MIN_COUNT}) * v.V / (ua.n * ub.n) > {L.PHRASE_THRESHOLD})"]


BIGRAMS_SQL = _ph_sql("corpus", "b_") + [
    "ph AS (SELECT coalesce(list(a || chr(1) || b), []::VARCHAR[]) AS phr FROM b_phrases)",
    "bg AS (SELECT row_id, list_transform([list_reduce(toks, lambda acc, x: CASE WHEN acc.prev IS NOT NULL "
    "AND list_contains(phr, acc.prev || chr(1) || x) THEN {'out': list_append(acc.out, acc.prev || '_' || x), 'prev': NULL} "
    "ELSE {'out': CASE WHEN acc.prev IS NOT NULL THEN list_append(acc.out, acc.prev) ELSE acc.out END, 'prev': x} END, "
    "{'out': []::VARCHAR[], 'prev': NULL::VARCHAR})], lambda r: CASE WHEN r.prev IS NOT NULL THEN list_append(r.out, r.prev) "
    "ELSE r.out END)[1] AS toks FROM corpus, ph)"]


@register("phrase_apply", W("SELECT row_id, array_to_string(toks, ' ') AS text_bigrams FROM bg", *BIGRAMS_SQL))
def phrase_apply(spark, sf):
    b = _bigrammed(spark, sf)
    return b.select("row_id", F.array_join("toks", " ").alias("text_bigrams"))


@register("phrase_fit_tri", W(
    f"SELECT a, b, CAST(n_ab AS BIGINT) AS n_ab, round(score, {R6}) AS score FROM t_phrases",
    *(BIGRAMS_SQL + _ph_sql("bg", "t_"))))
def phrase_fit_tri(spark, sf):
    b = _bigrammed(spark, sf)
    ph = TP.phrase_fit(b, "toks", threshold=L.PHRASE_THRESHOLD)
    return ph.select("a", "b", "n_ab", F.round("score", R6).alias("score"))


# ------------------------------------------------------------- dictionary --

DICT = ", ".join(BIGRAMS_SQL) + (", dict AS (SELECT d.term, CAST(d.df AS BIGINT) AS df, CAST(c.cf AS BIGINT) AS cf FROM "
        "(SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM bg) GROUP BY term) d "
        "JOIN (SELECT term, count(*) AS cf FROM (SELECT unnest(toks) AS term FROM bg) GROUP BY term) c USING (term))")
DICTF = (f"dictf AS (SELECT term, df, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS id FROM "
         f"(SELECT term, df FROM dict WHERE df >= {L.DICT_NO_BELOW} AND df <= {L.DICT_NO_ABOVE} * (SELECT count(*) FROM bg) "
         f"ORDER BY df DESC, term LIMIT {L.DICT_KEEP_N}))")


def _dict(spark, sf, c=None):
    c = _bigrammed(spark, sf) if c is None else c
    d = TP.dictionary_build(c, "toks")
    n = c.count()
    return c, d, TP.dictionary_filter(d, n)


@register("dictionary_build", W("SELECT term, df, cf FROM dict", DICT))
def dictionary_build(spark, sf):
    return TP.dictionary_build(_bigrammed(spark, sf), "toks")


@register("dictionary_filter", W("SELECT term, df, id FROM dictf", DICT, DICTF))
def dictionary_filter(spark, sf):
    _, _, f = _dict(spark, sf)
    return f.select("term", "df", "id")


@register("bag_of_words", W(
    "SELECT row_id, id, CAST(count(*) AS BIGINT) AS n FROM (SELECT row_id, unnest(toks) AS term FROM bg) x "
    "JOIN dictf USING (term) GROUP BY row_id, id", DICT, DICTF))
def bag_of_words(spark, sf):
    c, _, f = _dict(spark, sf)
    return TP.bag_of_words(c, "toks", f)


# -------------------------------------------------------------------- LDA --


def _features(spark, sf):
    """Bags of words, dictionary and texts of the topic corpus, stored."""
    c, _, f = _dict(spark, sf)
    f = cut_lineage(f.select("id", "term"))
    return TM.bags_of(c, "toks", f), f, c


BASIC = TM.Setting(4, passes=L.LDA_BASIC["passes"], seed=L.LDA_BASIC["seed"])
TUNED = TM.Setting(L.LDA_TUNED_EN["k"], L.LDA_TUNED_EN["alpha"], L.LDA_TUNED_EN["eta"], L.LDA_TUNED_EN["passes"],
                   L.LDA_TUNED_EN["chunk"], L.LDA_TUNED_EN["seed"])


def _fit(spark, sf, setting):
    """A fitted model with the bags and the dictionary it was fitted on."""
    bags, f, _ = _features(spark, sf)
    models = TM.fit(bags, [setting], f.count())
    return TM.TopicModel.of(models, 0, setting, f), models, bags, f


def _terms(models, f, n):
    return TM.top_terms(models, f, n).select("topic", "rank", "term", "weight")


@register("lda_fit")
def lda_fit(spark, sf):
    """Basic model (k=4) -> top 10 terms per topic."""
    _, models, _, f = _fit(spark, sf, BASIC)
    return _terms(models, f, 10)


@register("lda_fit_tuned")
def lda_fit_tuned(spark, sf):
    """Tuned model: each document's topic distribution sums to one."""
    model, _, bags, _ = _fit(spark, sf, TUNED)
    return model.infer(bags).select("row_id", F.size("shares").alias("n_topics"),
                                    F.round(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("lda_perplexity")
def lda_perplexity(spark, sf):
    model, _, bags, _ = _fit(spark, sf, TUNED)
    return spark.createDataFrame([(model.setting.k, model.log_perplexity(bags))], "k int, log_perplexity double")


@register("topic_top_terms")
def topic_top_terms(spark, sf):
    _, models, _, f = _fit(spark, sf, TUNED)
    return _terms(models, f, L.TOPIC_TERMS_N)


@register("sink_topic_terms")
def sink_topic_terms(spark, sf):
    _, models, _, f = _fit(spark, sf, TUNED)
    p = scratch_path(spark, "topic_terms")
    FS.write_csv(_terms(models, f, L.TOPIC_TERMS_N), p)
    from pyspark.sql.types import _parse_datatype_string
    return FS.read_csv(spark, p, _parse_datatype_string("topic int, rank int, term string, weight double"))


@register("model_store")
def model_store(spark, sf):
    """Save and reload the tuned model; the reloaded model gives the same
    topic distributions (max absolute difference per document)."""
    model, _, bags, _ = _fit(spark, sf, TUNED)
    p = scratch_path(spark, "lda_model")
    model.save(spark, p)
    a = model.infer(bags).withColumnRenamed("shares", "a")
    b = TM.TopicModel.load(spark, p).infer(bags).withColumnRenamed("shares", "b")
    return a.join(b, "row_id").select("row_id", F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("max_diff"))


def _inferred(spark, sf):
    """Topic shares of separately cleaned posts: the labelled posts, cleaned for
    topics and merged by the model's own phrases."""
    c = topic_corpus(spark, sf)
    phrases = cut_lineage(TP.phrase_fit(c, "toks"))
    c = cut_lineage(TP.phrase_apply(c, "toks", phrases))
    d = TP.dictionary_build(c, "toks")
    f = cut_lineage(TP.dictionary_filter(d, c.count()).select("id", "term"))
    model = TM.TopicModel.of(TM.fit(TM.bags_of(c, "toks", f), [TUNED], f.count()), 0, TUNED, f)
    posts = TB.labelled(spark, sf, text_work=True).select("row_id", topic_tokens("text").alias("toks"))
    posts = cut_lineage(TP.phrase_apply(cut_lineage(posts), "toks", phrases))
    return model, model.infer(TM.bags_of(posts, "toks", f))


@register("topic_infer")
def topic_infer(spark, sf):
    """The topics of the labelled posts by the model of the topic corpus."""
    _, got = _inferred(spark, sf)
    total = F.transform("shares", lambda p, i: F.struct(i.alias("topic"), p.alias("prob")))
    best = F.array_max(F.transform("shares", lambda p, i: F.struct(p.alias("prob"), i.alias("topic"))))
    return got.select("row_id", F.to_json(total).alias("LDAtotal"), best["topic"].alias("top_topic"))


@register("topic_columns")
def topic_columns(spark, sf):
    """topic1..topicK columns of the labelled posts, by topic number."""
    model, got = _inferred(spark, sf)
    return got.select("row_id", *[F.col("shares")[i].alias(f"topic{i + 1}") for i in range(model.setting.k)])


@register("lda_curve")
def lda_curve(spark, sf, limit: int = 10):
    """Mean coherence for k = 1..limit-1: the models are fitted in one job and
    scored from one pass over the texts."""
    bags, f, c = _features(spark, sf)
    settings = [TM.Setting(k, passes=L.LDA_BASIC["passes"], seed=L.LDA_BASIC["seed"]) for k in range(1, limit)]
    models = TM.fit(bags, settings, f.count())
    return (TM.coherence(models, f, c, "toks").groupBy("model").agg(F.avg("coherence").alias("coherence"))
            .select((F.col("model") + 1).alias("k"), "coherence"))


#: The reference's restarts ask for the library's defaults.
RESTART_TOPICS, RESTART_TERMS, RESTART_WINDOW = 100, 10, 10


@register("lda_restarts")
def lda_restarts(spark, sf, threshold: float = 0.97, max_tries: int = 32, together: int = 8):
    """Models with new seeds until the best topic's coherence (top 10 words,
    window 10) reaches ``threshold``, at most ``max_tries``: a row per try up to
    the first that reaches it.  ``together`` tries are fitted in one job and
    scored from one pass over the texts."""
    bags, f, c = _features(spark, sf)
    n = f.count()
    rows = []
    for first in range(0, max_tries, together):
        seeds = range(first, min(first + together, max_tries))
        models = TM.fit(bags, [TM.Setting(RESTART_TOPICS, seed=100 + i) for i in seeds], n)
        best = (TM.coherence(models, f, c, "toks", RESTART_WINDOW, RESTART_TERMS).where("NOT isnan(coherence)").groupBy("model")
                .agg(F.max(F.struct("coherence", (-F.col("topic")).alias("t"))).alias("b")).orderBy("model").collect())  # a row per try
        for r in best:
            i, value = first + r["model"], float(r["b"]["coherence"])
            rows.append((i, 100 + i, -r["b"]["t"], value, value >= threshold))
            if value >= threshold:
                return spark.createDataFrame(rows, RESTARTS)
    return spark.createDataFrame(rows, RESTARTS)


RESTARTS = "try int, seed int, best_topic int, best_coherence double, reached boolean"


@register("lda_grid")
def lda_grid(spark, sf, topics=L.LDA_GRID_TOPICS, alphas=L.LDA_GRID_ALPHA, betas=L.LDA_GRID_BETA):
    """The grid over L.LDA_GRID_*: 180 models of 50 passes, fitted in one job
    and scored from one pass over the texts."""
    from itertools import product
    bags, f, c = _features(spark, sf)
    points = list(product(topics, alphas, betas))
    p = L.LDA_TUNED_EN
    models = TM.fit(bags, [TM.Setting(k, a, b, p["passes"], p["chunk"], p["seed"]) for k, a, b in points], f.count())
    mean = TM.coherence(models, f, c, "toks").groupBy("model").agg(F.avg("coherence").alias("Coherence"))
    names = spark.createDataFrame([(i, "100% Corpus", k, str(a), str(b)) for i, (k, a, b) in enumerate(points)],
                                  "model int, Validation_Set string, Topics int, Alpha string, Beta string")
    return names.join(mean, "model", "left").select("Validation_Set", "Topics", "Alpha", "Beta", "Coherence")


# ------------------------------------------- coherence on fixed topics ----

def fixed_topic_corpus(spark, sf):
    """All posts, standardised and stop words removed (topics: languages)."""
    t = TB.texts(spark, sf)
    c = K.tok_stopwords(S.ascii_clean("text"), LEX)
    return cut_lineage(t.select("row_id", "lang", K.tok_split_ws(c).alias("toks")))


def fixed_topics(c, topn=10):
    """Each language's topn most frequent words: fixed, reproducible topics."""
    from pyspark.sql import Window
    cnt = c.select("lang", F.explode("toks").alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return cnt.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= topn).select(
        F.col("lang").alias("topic"), "term", "n")


def fixed_sql():
    e = O.stopwords(S.ascii_clean_sql("text"))
    return [f"tweets AS ({TB.SQL_VIEWS['tweets']})",
            f"fc AS (SELECT row_id, lang, {O.split_ws(e)} AS toks FROM tweets)",
            "cnt AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(toks) AS term FROM fc) GROUP BY 1, 2)",
            "ft AS (SELECT lang AS topic, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r "
            "FROM cnt) WHERE r <= 10)"]


def coherence_sql(window):
    return fixed_sql() + [
        "allw AS (SELECT list(DISTINCT term) AS w FROM ft)",
        f"wins AS (SELECT row_number() OVER () AS wid, ws FROM (SELECT unnest(list_transform(range(0, greatest(len(toks) - {window}, 0) + 1), "
        f"lambda i: list_distinct(list_intersect(toks[i + 1:i + {window}], w)))) AS ws FROM fc, allw))",
        "tot AS (SELECT count(*) AS T FROM wins)",
        "single AS (SELECT w, count(*) AS n_w FROM (SELECT unnest(ws) AS w FROM wins) GROUP BY w)",
        "uw AS (SELECT wid, unnest(ws) AS w FROM wins)",
        "pairs AS (SELECT x.w AS a, y.w AS b, count(*) AS n_ab FROM uw x JOIN uw y ON x.wid = y.wid AND x.w < y.w GROUP BY 1, 2)",
        "m AS (SELECT t1.topic, t1.term AS wi, t2.term AS wj, "
        "ln((CASE WHEN t1.term = t2.term THEN si.n_w ELSE coalesce(p.n_ab, 0) END / tot.T + 1e-12) / ((si.n_w / tot.T) * (sj.n_w / tot.T))) "
        "/ (-ln(CASE WHEN t1.term = t2.term THEN si.n_w ELSE coalesce(p.n_ab, 0) END / tot.T + 1e-12)) AS v "
        "FROM ft t1 JOIN ft t2 ON t1.topic = t2.topic LEFT JOIN single si ON si.w = t1.term LEFT JOIN single sj ON sj.w = t2.term "
        "LEFT JOIN pairs p ON p.a = least(t1.term, t2.term) AND p.b = greatest(t1.term, t2.term), tot)",
        "vs AS (SELECT topic, wj, sum(v) AS s FROM m GROUP BY 1, 2)",
        "pw AS (SELECT m.topic, m.wi, sum(m.v * vs.s) / (sqrt(sum(m.v * m.v)) * sqrt(sum(vs.s * vs.s))) AS cos "
        "FROM m JOIN vs ON m.topic = vs.topic AND m.wj = vs.wj GROUP BY 1, 2)",
        "coh AS (SELECT topic, avg(cos) AS coherence FROM pw GROUP BY topic)"]


def _fixed_coherence(spark, sf, window):
    c = fixed_topic_corpus(spark, sf)
    return TP.coherence_cv(c, "toks", fixed_topics(c).select("topic", "term"), window)


@register("coherence_cv", "WITH " + ", ".join(coherence_sql(L.COHERENCE_WINDOW))
          + f" SELECT topic, round(coherence, {R6}) AS coherence FROM coh")
def coherence_cv(spark, sf):
    return _fixed_coherence(spark, sf, L.COHERENCE_WINDOW).select("topic", F.round("coherence", R6).alias("coherence"))


@register("coherence_per_topic", "WITH " + ", ".join(coherence_sql(10))
          + f" SELECT topic, round(coherence, {R6}) AS coherence FROM coh")
def coherence_per_topic(spark, sf):
    return _fixed_coherence(spark, sf, 10).select("topic", F.round("coherence", R6).alias("coherence"))


@register("rank_topics", "WITH " + ", ".join(coherence_sql(10))
          + f" SELECT topic, round(coherence, {R6}) AS coherence, CAST(row_number() OVER (ORDER BY coherence DESC, topic) AS INTEGER) AS rank FROM coh")
def rank_topics(spark, sf):
    from pyspark.sql import Window
    coh = _fixed_coherence(spark, sf, 10)
    w = Window.orderBy(F.desc("coherence"), "topic")  # one row per topic
    return coh.select("topic", F.round("coherence", R6).alias("coherence"), F.row_number().over(w).alias("rank"))


@register("topic_relevance", "WITH " + ", ".join(fixed_sql() + [
    "tf AS (SELECT term, sum(n) AS n FROM cnt GROUP BY term)",
    "tt AS (SELECT lang AS topic, term, n AS weight FROM cnt)",
    "pt AS (SELECT t.topic, t.term, t.weight / s.tw AS p_wt FROM tt t JOIN (SELECT topic, sum(weight) AS tw FROM tt GROUP BY topic) s USING (topic))",
    "r AS (SELECT pt.topic, pt.term, pt.p_wt, pt.p_wt / (tf.n / (SELECT sum(n) FROM tf)) AS lift FROM pt JOIN tf USING (term))",
    "rr AS (SELECT *, 0.6 * ln(p_wt) + 0.4 * ln(lift) AS relevance FROM r)"])
    + f" SELECT topic, term, round(p_wt, {R6}) AS p_wt, round(lift, {R6}) AS lift, round(relevance, {R6}) AS relevance, rank FROM "
    f"(SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, term) AS INTEGER) AS rank FROM rr) WHERE rank <= {L.TOPIC_TERMS_N}")
def topic_relevance(spark, sf):
    c = fixed_topic_corpus(spark, sf)
    cnt = c.select("lang", F.explode("toks").alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).cache()
    tt = cnt.select(F.col("lang").alias("topic"), "term", F.col("n").alias("weight"))
    tf = cnt.groupBy("term").agg(F.sum("n").alias("n"))
    r = TP.topic_relevance(tt, tf, 0.6, L.TOPIC_TERMS_N)
    return r.select("topic", "term", *[F.round(x, R6).alias(x) for x in ("p_wt", "lift", "relevance")], "rank")


@register("topic_distances", "WITH " + ", ".join(fixed_sql() + [
    "p AS (SELECT lang AS topic, term, n / sum(n) OVER (PARTITION BY lang) AS p FROM cnt WHERE lang IS NOT NULL)",
    "al AS (SELECT x.topic AS a, y.topic AS b, t.term FROM (SELECT DISTINCT topic FROM p) x JOIN (SELECT DISTINCT topic FROM p) y ON x.topic < y.topic, "
    "(SELECT DISTINCT term FROM p) t)",
    "pq AS (SELECT al.a, al.b, coalesce(x.p, 0) AS pa, coalesce(y.p, 0) AS pb FROM al LEFT JOIN p x ON x.topic = al.a AND x.term = al.term "
    "LEFT JOIN p y ON y.topic = al.b AND y.term = al.term)"])
    + f" SELECT a, b, round(sum(CASE WHEN pa > 0 THEN 0.5 * pa * ln(pa / ((pa + pb) / 2)) ELSE 0 END + "
      f"CASE WHEN pb > 0 THEN 0.5 * pb * ln(pb / ((pa + pb) / 2)) ELSE 0 END), {R6}) AS distance FROM pq GROUP BY a, b")
def topic_distances(spark, sf):
    """Jensen-Shannon divergences of the languages' term counts."""
    c = fixed_topic_corpus(spark, sf).where("lang IS NOT NULL")
    cnt = c.select(F.col("lang").alias("topic"), F.explode("toks").alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("weight"))
    return TP.topic_distances(cut_lineage(cnt)).select("a", "b", F.round("distance", R6).alias("distance"))


@register("topic_map")
def topic_map(spark, sf):
    """The map of the tuned model's topics: places by classical scaling of their
    divergences, share of each topic."""
    _, models, _, f = _fit(spark, sf, TUNED)
    return TP.topic_map(cut_lineage(_terms(models, f, f.count()).select("topic", "term", "weight")))
