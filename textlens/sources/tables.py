"""Input tables with declared schemas, and the stand-in views.

Schemas are declared (no inference).  The views rename the stand-in tables to
the reference's data model: ``tweets`` (row_id, text, lang, username) and
``labelled`` (row_id, text, target, sentiment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType())]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType())]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType())]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType())]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]),
}


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    r = spark.read
    if name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    return r.parquet(path(sf_dir, name))


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Spread CPU-bound text work over the cluster's cores.

    Text cleaning costs far more per byte than the scan.  When the scan
    yields fewer partitions than the default parallelism (one large row group,
    or a small file) rows are hash-partitioned on ``key`` (deterministic on
    retry, unlike round robin).  On a cluster reading many files the scan
    already has more splits than cores and nothing is added.  Lazy: only the
    splits of the scan are looked at, and later projections still prune it.

    The condition that always holds is not deterministic to Catalyst, which
    keeps it from pushing later (expensive, inlined) text predicates below the
    repartition into the few scan tasks.  So filter plain columns first."""
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key).where(F.monotonically_increasing_id() >= 0)


# ---------------------------------------------------------------- views ----

def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, as a plain scan: filters and projections reach it."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), "text", "lang",
                    F.col("source").alias("username"))


def texts(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Posts (of one language), spread for CPU-bound work on their text."""
    t = tweets(spark, sf_dir)
    return spread(t if lang is None else t.filter(F.col("lang") == lang))


def sentiment_of(doc_id, toxic):
    return (F.when(toxic == 1, "negative")
            .when(F.pmod(doc_id, F.lit(3)) == 0, "positive").otherwise("neutral"))


def labelled(spark: SparkSession, sf_dir: str, text_work: bool = False) -> DataFrame:
    """Labelled posts: documents joined to labels (both keyed by doc_id).
    With ``text_work`` the scan of the documents is spread before the join."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if text_work:
        d = spread(d, "doc_id")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "inner")
    return j.select(
        F.col("doc_id").alias("row_id"), "text",
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("target"),
        sentiment_of(F.col("doc_id"), F.col("toxic")).alias("sentiment"))


# A fixed prefix that gives every stand-in post the features tweets have and
# the generated prose lacks (retweet mark, mention, link, hashtag, possessive,
# contraction, fraction, html literal and tag, picture link, station name).
NOISY_PREFIX = ("RT @acct http://x.y/z #tag the driver's seat, don't wait 2½ {html}"
                "<b>at</b> kl sentral pic.twitter.com/q1 xnak xpress ")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    return t.withColumn("text", F.concat(F.lit(NOISY_PREFIX), F.col("text")))


# The views as text work reads them.
TEXT_VIEWS = {"tweets": texts, "noisy": noisy}

# SQL (DuckDB) forms of the same views, as CTE bodies.
SQL_VIEWS = {
    "tweets": "SELECT doc_id AS row_id, text, lang, source AS username FROM documents",
    "labelled": ("SELECT d.doc_id AS row_id, d.text, "
                 "CASE l.quality WHEN 1 THEN 'yes' ELSE 'no' END AS target, "
                 "CASE WHEN l.toxic = 1 THEN 'negative' WHEN d.doc_id % 3 = 0 THEN 'positive' "
                 "ELSE 'neutral' END AS sentiment FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "noisy": ("SELECT doc_id AS row_id, '" + NOISY_PREFIX.replace("'", "''")
              + "' || text AS text, lang, source AS username FROM documents"),
}


def with_views(sql: str, *names: str) -> str:
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {ctes} {sql}" if names else sql
