"""Features, splits, folds, classifiers and evaluation.

Order-dependent operators (exact train/test split, stratified folds, ROC
running sums) never use one global window over the data.  ``bucketed_rank``
and ``running_totals`` give exact global ranks / prefix sums: rows are cut
into ordered buckets, per-bucket totals (a small table) give each bucket's
offset, and the remaining window runs per bucket, in parallel.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Bucketizer, CountVectorizer, PolynomialExpansion, RegexTokenizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L


# ------------------------------------------------------ ranks and totals --

def bucketed_rank(df: DataFrame, bucket: Column, order, partition=(), name: str = "rank") -> DataFrame:
    """Exact 1-based rank of each row in ``order`` within ``partition``.

    ``bucket`` must be monotone in the order (ties share a bucket).  The
    per-(partition, bucket) counts are a small table; its prefix sums are the
    offsets; ``row_number`` then runs within each bucket."""
    part = list(partition)
    d = df.withColumn("_b", bucket)
    counts = d.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    within = Window.partitionBy(*part, "_b").orderBy(*order)
    r = d.join(F.broadcast(offs), [*part, "_b"]).withColumn(name, F.col("_off") + F.row_number().over(within))
    return r.drop("_b", "_off")


#: Rows that one bucket of a rank or running sum should hold.
BUCKET_ROWS = 100_000


def bucket_count(rows: int) -> int:
    """Buckets for so many rows: their number grows with the table."""
    return max(8, -(-rows // BUCKET_ROWS))


def with_quantile_bucket(df: DataFrame, col: str, out: str = "_b") -> DataFrame:
    """``df`` with a bucket of ``col``, monotone in it, by approximate
    quantiles: one boundary for each ``BUCKET_ROWS`` rows reaches the driver,
    and each row finds its bucket by binary search."""
    n = bucket_count(df.count())
    bounds = df.agg(F.percentile_approx(col, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or []
    splits = [-math.inf, *sorted({float(b) for b in bounds}), math.inf]
    tmp = f"{out}_x"
    d = df.withColumn(tmp, F.col(col).cast("double"))
    d = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(d)
    return d.withColumn(out, F.col(out).cast("int")).drop(tmp)


def running_totals(df: DataFrame, order_col: str, cols, descending: bool = False,
                   keep_bucket: bool = False) -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order_col`` order (one row
    per distinct order value expected)."""
    d = df.withColumn("_key", -F.col(order_col) if descending else F.col(order_col))
    d = with_quantile_bucket(d, "_key")
    tot = d.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row per bucket
    offs = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in cols])
    within = Window.partitionBy("_b").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    r = d.join(F.broadcast(offs), "_b")
    for c in cols:
        r = r.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(within))
    r = r.drop(*[f"_o_{c}" for c in cols])
    return r if keep_bucket else r.drop("_b", "_key")


# ---------------------------------------------------------------- labels --

def label_encode(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """Labels -> 0..n-1 in sorted order of the label values."""
    idx = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")
    return idx.fit(df).transform(df).withColumn(out, F.col(out).cast("int"))


def hash_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def split_train_test(df: DataFrame, test_size: float = L.TEST_SIZE, seed: int = L.SEEDS["split_en"],
                     key: str = "row_id") -> DataFrame:
    """Exact-size seeded split: rows ranked by md5(key:seed); the first
    ceil(test_size * n) are 'test'.  Ranks come from buckets of the hash's
    first 28 bits, as many as the rows ask for, so no task sees more than its
    bucket."""
    n = df.count()
    n_test = int(math.ceil(test_size * n))
    h = hash_key(F.col(key), seed)
    d = df.withColumn("_h", h)
    bucket = F.floor(F.conv(F.substring("_h", 1, 7), 16, 10).cast("long") * F.lit(bucket_count(n)) / F.lit(1 << 28)).cast("int")
    r = bucketed_rank(d, bucket, ["_h", key], name="_r")
    return r.withColumn("split", F.when(F.col("_r") <= n_test, "test").otherwise("train")).drop("_h", "_r")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """'balanced' weights n / (k * n_c) as (label, n, weight)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the k class rows only
    return c.select(label, "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label).select(label, F.col("weight").alias(out))), label)


def stratified_folds(df: DataFrame, label: str = "label", n_splits: int = L.CV_FOLDS, key: str = "row_id",
                     out: str = "fold") -> DataFrame:
    """Unshuffled stratified k-fold: within each class, rows in key order
    fill folds 0..k-1 with the sizes the sorted-label allocation gives (sizes
    differ by at most one)."""
    counts = sorted((r[0], r[1]) for r in df.groupBy(label).count().collect())  # one row per class
    rows, start = [], 0
    for lab, n in counts:
        cum = 0
        for f in range(n_splits):
            # positions j in [start, start + n) of the sorted labels with j % n_splits == f
            size = len(range(start + ((f - start) % n_splits), start + n, n_splits))
            rows.append((lab, f, cum, cum + size))
            cum += size
        start += n
    spark = df.sparkSession
    ltype = dict(df.dtypes)[label]
    alloc = spark.createDataFrame(rows, f"{label} {ltype}, {out} int, lo long, hi long")
    r = bucketed_rank(with_quantile_bucket(df, key, "_q"), F.col("_q"), [key], partition=[label], name="_r").withColumn("_r", F.col("_r") - 1)
    j = r.join(F.broadcast(alloc), (r[label] == alloc[label]) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi")))
    return j.select(*[r[c] for c in df.columns], F.col(out)).drop("_r")


# ------------------------------------------------------------- features --

def words_of(text: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def count_terms(df: DataFrame, text: str, out: str = "counts", min_df: float = 1.0):
    """Pipeline: lower-cased words of two or more characters -> sparse term
    counts over all terms of ``df`` (their number is counted first)."""
    terms = max(1, df.select(F.explode(words_of(F.col(text))).alias("t")).distinct().count())
    tok = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False,
                         toLowercase=True)
    cv = CountVectorizer(inputCol="_words", outputCol=out, minDF=min_df, vocabSize=terms)
    return Pipeline(stages=[tok, cv])


def tfidf(df: DataFrame, tokens: str, key: str = "row_id") -> DataFrame:
    """(key, term, weight): tf * (ln((1+n)/(1+df)) + 1), rows L2-normalised."""
    n = df.count()
    tf = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    dfq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = dfq.select("term", (F.log((F.lit(1.0 + n)) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") ** 2)).alias("nrm"))
    return w.join(norm, key).select(key, "term", (F.col("raw") / F.col("nrm")).alias("weight"))


def rff_features(df: DataFrame, features: str, dim_in: int, n_components: int, gamma: float, seed: int,
                 out: str = "rff") -> DataFrame:
    """Random Fourier features for an RBF kernel (Rahimi & Recht 2007):
    z = sqrt(2/D) cos(xW + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).  The
    matrix is regenerated from the seed inside each Arrow batch (nothing to
    broadcast); numpy does the batch product."""
    import numpy as np
    import pandas as pd
    schema = df.select("*", F.array(F.lit(0.0)).alias(out)).schema

    def run(batches):
        rng = np.random.default_rng(seed)
        W = rng.normal(0.0, math.sqrt(2 * gamma), size=(dim_in, n_components))
        b = rng.uniform(0, 2 * math.pi, size=n_components)
        scale = math.sqrt(2.0 / n_components)
        for pdf in batches:
            X = np.vstack(pdf[features].map(lambda a: np.asarray(a, dtype=float)).to_numpy()) \
                if len(pdf) else np.zeros((0, dim_in))
            Z = scale * np.cos(X @ W + b)
            pdf[out] = pd.Series(list(Z), index=pdf.index)
            yield pdf
    return df.mapInPandas(run, schema)


def as_vector(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col)))


# ------------------------------------------------------------ estimators --

def rf(trees=10, features="sqrt", criterion="gini", depth=5, leaf=1, seed=42, weight_col=None):
    kw = dict(numTrees=trees, featureSubsetStrategy="sqrt" if features == "auto" else features,
              impurity=criterion, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    if weight_col:
        kw["weightCol"] = weight_col
    return RandomForestClassifier(**kw)


def gbt(depth=3, trees=60, rate=0.1, seed=L.SEEDS["boosted"]):
    return GBTClassifier(maxDepth=depth, maxIter=trees, stepSize=rate, lossType="logistic", seed=seed)


def linear_svm(C=1000.0, n=1):
    """regParam = 1 / (C n) mirrors the soft-margin constant."""
    return LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=50)


def poly_features(df: DataFrame, degree: int = 3, components: int = 8) -> DataFrame:
    """All products up to ``degree`` of the first principal components of
    ``features`` (of all 64 features there would be 47,904)."""
    pca = PCA(k=components, inputCol="features", outputCol="_pc").fit(df)
    poly = PolynomialExpansion(degree=degree, inputCol="_pc", outputCol="_poly")
    return poly.transform(pca.transform(df)).drop("features", "_pc").withColumnRenamed("_poly", "features")


def platt(raw_col: str = "rawPrediction", label: str = "label"):
    """Probability calibration on the SVM margin (Platt 1999)."""
    return LogisticRegression(featuresCol="margin_vec", labelCol=label, probabilityCol="probability",
                              predictionCol="platt_prediction", rawPredictionCol="platt_raw")


def margin_vector(df: DataFrame, raw_col: str = "rawPrediction") -> DataFrame:
    return df.withColumn("margin_vec", array_to_vector(F.array(vector_to_array(F.col(raw_col))[1])))


def prob1(col: str = "probability") -> Column:
    return vector_to_array(F.col(col))[1]


# ------------------------------------------------------------- metrics --

def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """precision, recall, f1, support per class, then macro and weighted
    averages.  One pass counts (label, prediction) pairs; the rest works on
    those few rows."""
    pairs = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("l").cast("double").alias("c"), F.lit(1).alias("is_label")),
                    F.struct(F.col("p").cast("double").alias("c"), F.lit(0).alias("is_label")))
    s = pairs.select("l", "p", "n", F.explode(sides).alias("s"))
    same = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    j = s.groupBy(F.col("s.c").cast(dict(df.dtypes)[label]).alias("c")).agg(
        F.sum(F.when(F.col("s.is_label") == 1, same).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_label") == 0, F.col("n")).otherwise(0)).alias("npred"))
    p = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = j.select(F.col("c").cast("string").alias("class"), p.alias("precision"), r.alias("recall"), "support")
    per = per.withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
    per = per.select("class", "precision", "recall", "f1", F.col("support").cast("long"))
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").cast("long").alias("support"))
    wsum = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / wsum).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / wsum).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / wsum).alias("f1"), wsum.cast("long").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def confusion_matrix(df: DataFrame, classes, label: str = "label", pred: str = "prediction") -> DataFrame:
    names = [f"pred_{c}" for c in classes]
    m = df.groupBy(label).pivot(pred, list(classes)).agg(F.count(F.lit(1)))
    return m.select(label, *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(nm) for c, nm in zip(classes, names)])


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) at the distinct scores, descending, after the
    (inf, 0, 0) start.  With ``drop_intermediate`` a threshold is kept only
    where the curve bends (its step to the next threshold differs from its
    own step), plus the first and the last -- the usual default.  Scores are
    pre-aggregated; running sums and the "next point" come from ordered
    buckets, never one global window."""
    agg = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    tot = df.agg(F.sum(F.col(label).cast("long")).alias("P"), F.sum((1 - F.col(label)).cast("long")).alias("N")).first()
    r = running_totals(agg, score, ["pos", "neg"], descending=True, keep_bucket=True)
    if drop_intermediate:
        within = Window.partitionBy("_b").orderBy("_key")
        r = r.withColumn("_npos", F.lead("pos").over(within)).withColumn("_nneg", F.lead("neg").over(within))
        firsts = r.groupBy("_b").agg(F.min_by(F.struct("pos", "neg"), F.col("_key")).alias("f"))
        wb = Window.orderBy("_b")  # over one row per bucket
        firsts = firsts.select("_b", F.lead("f").over(wb).alias("nf"))
        r = r.join(F.broadcast(firsts), "_b", "left")
        npos = F.coalesce(F.col("_npos"), F.col("nf.pos"))
        nneg = F.coalesce(F.col("_nneg"), F.col("nf.neg"))
        first_key = r.agg(F.min("_key")).first()[0]
        keep = (npos.isNull() | (F.col("_key") == F.lit(first_key))
                | (npos != F.col("pos")) | (nneg != F.col("neg")))
        r = r.filter(keep)
    curve = r.select(F.col(score).cast("double").alias("threshold"),
                     (F.col("cum_neg") / F.lit(float(tot["N"]))).alias("fpr"),
                     (F.col("cum_pos") / F.lit(float(tot["P"]))).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(curve)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under ROC with ties counted half (rank-sum form)."""
    agg = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    r = running_totals(agg, score, ["neg"], descending=False)
    below = F.col("cum_neg") - F.col("neg")
    return r.agg(((F.sum(F.col("pos") * below) + 0.5 * F.sum(F.col("pos") * F.col("neg")))
                  / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def score_summary(df: DataFrame, group: str, score: str) -> DataFrame:
    """min, quartiles, median, max per group (exact percentiles)."""
    p = F.percentile(score, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    s = df.groupBy(group).agg(p.alias("q"))
    return s.select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(["min", "q1", "median", "q3", "max"])])
