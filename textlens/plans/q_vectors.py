"""Queries for word vectors and document vectors.

Stand-in word vectors: every distinct corpus token maps to an ``embeddings``
row by md5 modulo the number of ids and a quarter more; so every row is used,
and one token in five is left out of the vocabulary (documents mix known and
unknown tokens).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import tokens as K
from ..operators import relational as R
from ..operators import skipgram as SG
from ..operators import vectors as VX
from ..session import cut_lineage
from ..sources import tables as TB
from . import oracle as O
from . import stages as S
from .catalog import register

DIM = 64
MOD_SQL = "(SELECT 5 * (coalesce(max(vec_id), -1) + 1) // 4 + 1 FROM embeddings)"
R6 = 6


def corpus(spark, sf):
    return cut_lineage(TB.texts(spark, sf).select("row_id", K.tok_words(S.ascii_clean("text")).alias("toks")))


def vectors(spark, sf, c=None):
    c = corpus(spark, sf) if c is None else c
    emb = TB.table(spark, sf, "embeddings")
    return VX.token_vectors(c.select(F.explode("toks").alias("tok")), emb, modulus(emb))


def modulus(embeddings):
    """The ids 0..max, and a quarter more that no row has."""
    top = embeddings.agg(F.max("vec_id")).first()[0]
    return 5 * ((-1 if top is None else top) + 1) // 4 + 1




def sql_base():
    return [f"tweets AS ({TB.SQL_VIEWS['tweets']})",
            f"ct AS (SELECT row_id, {O.words(S.ascii_clean_sql('text'))} AS toks FROM tweets)",
            "tv AS (SELECT t.tok AS word, CAST(e.embedding AS DOUBLE[]) AS vector FROM (SELECT DISTINCT unnest(toks) AS tok FROM ct) t "
            f"JOIN embeddings e ON e.vec_id = (('0x' || substr(md5(t.tok), 1, 8))::BIGINT % {MOD_SQL}))",
            "ex AS (SELECT c.row_id, x.tok FROM (SELECT row_id, unnest(toks) AS tok FROM ct) x JOIN ct c USING (row_id))"]


def W(body, *extra):
    return "WITH " + ", ".join(sql_base() + list(extra)) + " " + body


MEANS = ("dm AS (SELECT row_id, d, avg(v) AS m FROM (SELECT e.row_id, unnest(tv.vector) AS v, "
         "generate_subscripts(tv.vector, 1) AS d FROM (SELECT row_id, unnest(toks) AS tok FROM ct) e "
         "JOIN tv ON e.tok = tv.word) GROUP BY row_id, d)")
KNOWN = ("kn AS (SELECT e.row_id, count(*) AS n FROM (SELECT row_id, unnest(toks) AS tok FROM ct) e "
         "JOIN tv ON e.tok = tv.word GROUP BY e.row_id)")
DOC_MEAN_SQL = W(
    f"SELECT c.row_id, CAST(coalesce(kn.n, 0) AS BIGINT) AS n_known, "
    f"round(coalesce(max(dm.m) FILTER (WHERE dm.d = 1), 0), {R6}) AS m0, "
    f"round(coalesce(max(dm.m) FILTER (WHERE dm.d = 2), 0), {R6}) AS m1, "
    f"round(coalesce(sqrt(sum(dm.m * dm.m)), 0), {R6}) AS norm "
    f"FROM ct c LEFT JOIN kn ON c.row_id = kn.row_id LEFT JOIN dm ON c.row_id = dm.row_id GROUP BY c.row_id, kn.n",
    MEANS, KNOWN)


def _summary(df, col="features"):
    arr = F.col(col)
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x))
    return df.select("row_id", "n_known", F.round(arr[0], R6).alias("m0"), F.round(arr[1], R6).alias("m1"),
                     F.round(norm, R6).alias("norm"))


@register("doc_mean_vector", DOC_MEAN_SQL)
def doc_mean_vector(spark, sf):
    c = corpus(spark, sf)
    m = VX.doc_mean_vector(c, "toks", vectors(spark, sf, c), DIM)
    return _summary(m)


@register("mean_embedding_transformer", DOC_MEAN_SQL)
def mean_embedding_transformer(spark, sf):
    """The same mean as a pipeline stage (Transformer)."""
    from pyspark.ml.functions import vector_to_array
    c = corpus(spark, sf)
    stage = VX.MeanEmbedding(vectors(spark, sf, c), DIM, inputCol="toks", outputCol="vec")
    out = stage.transform(c)
    out = out.withColumn("features", vector_to_array("vec"))
    return _summary(out)


@register("join_token_vectors", W("SELECT row_id, CAST(n AS BIGINT) AS n_known FROM kn", KNOWN))
def join_token_vectors(spark, sf):
    c = corpus(spark, sf)
    v = vectors(spark, sf, c).withColumnRenamed("word", "tok")
    ex = c.select("row_id", F.explode("toks").alias("tok"))
    return ex.join(v, "tok").groupBy("row_id").agg(F.count(F.lit(1)).alias("n_known"))


@register("w2v_similarity", (
    f"SELECT e1.vec_id, round(list_cosine_similarity(CAST(e1.embedding AS DOUBLE[]), CAST(e2.embedding AS DOUBLE[])), {R6}) "
    "AS similarity FROM embeddings e1 JOIN embeddings e2 ON e2.vec_id = e1.vec_id + 1"))
def w2v_similarity(spark, sf):
    """Cosine of each vector with the next one (a self-join on id)."""
    e = TB.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(VX.cosine(F.col("v"), F.col("w")), R6).alias("similarity"))


@register("nearest_terms", (
    f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings "
    f"WHERE vec_id = 0)), {R6}) AS similarity FROM embeddings WHERE vec_id <> 0 "
    f"ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id "
    f"LIMIT {L.NEAREST_TOPN}"))
def nearest_terms(spark, sf):
    e = TB.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = VX.nearest_terms(e, 0, L.NEAREST_TOPN, word="vec_id", vec="v")
    return n.select("vec_id", F.round("similarity", R6).alias("similarity"))


# ------------------------------------------------------ fitted word vectors --

def event_tokens(spark, sf):
    """Tokens of the event rows: labelled posts about the event, positive
    sentiment dropped, as the sentiment flow sees them."""
    lab = TB.labelled(spark, sf, text_work=True)
    ev = R.filter_event_rows(R.filter_not_label(lab, "sentiment", "positive"), "target", "yes")
    return cut_lineage(ev.select("row_id", K.tok_words(S.ascii_clean("text")).alias("toks")))


def event_vectors(spark, sf, more=0, p=L.W2V_EN):
    """Word vectors fitted on the event rows at the declared settings; with
    ``more`` further iterations from the fitted vectors."""
    rows = event_tokens(spark, sf)
    settings = dict(size=p["size"], window=p["window"], min_count=p["min_count"], negative=p["negative"], seed=p["seed"])
    model = SG.fit(rows, "toks", iters=p["iters"], **settings)
    if more:
        model = SG.fit(rows, "toks", iters=more, fitted=model, **settings)
    return model


@register("w2v_fit")
def w2v_fit(spark, sf):
    """The vocabulary of the fitted vectors with their dimensions."""
    return event_vectors(spark, sf).select("word", F.size("vector").alias("dims"))


@register("w2v_continue")
def w2v_continue(spark, sf):
    """A fit that goes on for ten iterations from the fitted vectors."""
    return event_vectors(spark, sf, more=L.W2V_CONTINUE_EPOCHS).select("word", F.size("vector").alias("dims"))


@register("w2v_vectors")
def w2v_vectors(spark, sf):
    return event_vectors(spark, sf).select("word", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
