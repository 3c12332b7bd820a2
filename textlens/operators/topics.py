"""Topic modelling: phrases, dictionary, bags of words, c_v coherence, term
relevance; the models themselves are in ``topic_models``.

Counting work (unigrams, adjacent pairs, document frequencies, sliding
window co-occurrence) is expressed as explode + ``groupBy`` so it runs
distributed with partial aggregation.  Only bounded tables reach the driver:
the pruned vocabulary (at most ``keep_n`` terms) and a model's top words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..session import cut_lineage
from .linguistics import sized_for_join

EPSILON = 1e-12
#: Phrases up to which their table is broadcast (two words each).
PHRASE_BROADCAST_ROWS = 500_000
#: More top words than this are joined as a table.
LITERAL_TERMS = 500


# ---------------------------------------------------------------- phrases --

def adjacent_pairs(tokens: Column) -> Column:
    """ARRAY<STRUCT<a, b>> of adjacent tokens."""
    return F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
                      F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
                      lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def phrase_counts(df: DataFrame, tokens: str):
    """(unigram counts, pair counts, vocabulary size) of a tokenised corpus.
    The vocabulary size counts distinct unigrams plus distinct pairs."""
    uni = df.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = (df.select(F.explode(adjacent_pairs(F.col(tokens))).alias("p"))
             .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n_ab")))
    return uni, pairs


def phrase_fit(df: DataFrame, tokens: str, min_count: int = L.PHRASE_MIN_COUNT,
               threshold: float = L.PHRASE_THRESHOLD) -> DataFrame:
    """(a, b, n_ab, score): pairs whose score
    ``(n_ab - min_count) * V / (n_a * n_b)`` exceeds ``threshold``."""
    uni, pairs = phrase_counts(df, tokens)
    uni, pairs = uni.cache(), pairs.cache()
    v = uni.count() + pairs.count()  # vocabulary size: a scalar, not a join
    na = uni.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    nb = uni.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    j = pairs.join(na, "a").join(nb, "b")
    score = (F.col("n_ab") - F.lit(min_count)).cast("double") * F.lit(float(v)) / (F.col("n_a") * F.col("n_b"))
    return (j.withColumn("score", score).filter(F.col("score") > threshold)
            .select("a", "b", "n_ab", "score"))


def phrase_apply(df: DataFrame, tokens: str, phrases: DataFrame, key: str = "row_id", joiner: str = "_") -> DataFrame:
    """Greedy left-to-right merge of adjacent pairs that are phrases
    (``a b c`` with phrases a_b and b_c gives ``a_b c``) in the column
    ``tokens``; ``phrases`` has columns a, b; ``key`` names a row.

    Adjacent pairs meet the phrases in a join, so neither side needs a bound;
    up to PHRASE_BROADCAST_ROWS phrases, by a count, are broadcast, and pairs
    that are none go before any exchange.
    In a run of hits at consecutive places the first, third, ... merge; the
    text is then put together from the slices between the merged places."""
    found, _ = sized_for_join(phrases.select("a", "b"), PHRASE_BROADCAST_ROWS)
    pairs = df.select(key, F.posexplode(adjacent_pairs(F.col(tokens))).alias("at", "p"))
    hits = (pairs.select(key, "at", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
            .join(found, ["a", "b"]).select(key, "at"))
    run = F.col("at") - F.row_number().over(Window.partitionBy(key).orderBy("at"))
    turn = F.row_number().over(Window.partitionBy(key, "run").orderBy("at"))
    merged = (hits.withColumn("run", run).withColumn("turn", turn).where(F.col("turn") % 2 == 1)
              .groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("_at")))

    def part(at, i):  # the tokens since the last merge, and the merged pair (places count from 0)
        since = F.when(i == 0, 0).otherwise(F.try_element_at("_at", i) + 2)
        pair = F.concat(F.get(tokens, at), F.lit(joiner), F.get(tokens, at + 1))
        return F.concat(F.slice(tokens, since + 1, at - since), F.array(pair))

    tail = F.element_at("_at", -1) + 2
    whole = F.concat(F.flatten(F.transform("_at", part)), F.slice(tokens, tail + 1, F.greatest(F.size(tokens) - tail, F.lit(0))))
    out = df.join(merged, key, "left").withColumn(tokens, F.when(F.col("_at").isNull(), F.col(tokens)).otherwise(whole))
    return out.drop("_at")


# ------------------------------------------------------------- dictionary --

def dictionary_build(df: DataFrame, tokens: str) -> DataFrame:
    """(term, df, cf): document and collection frequency of every term."""
    cf = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    dfq = df.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    return dfq.join(cf, "term")


def dictionary_filter(dictionary: DataFrame, n_docs: int, no_below: int = L.DICT_NO_BELOW,
                      no_above: float = L.DICT_NO_ABOVE, keep_n: int = L.DICT_KEEP_N) -> DataFrame:
    """Keep terms in at least ``no_below`` documents and at most
    ``no_above`` of them, the ``keep_n`` most frequent by document frequency;
    ids 0.. by (df desc, term).  The id window runs over at most keep_n rows."""
    kept = dictionary.filter((F.col("df") >= no_below) & (F.col("df") <= no_above * n_docs))
    top = kept.orderBy(F.desc("df"), "term").limit(keep_n)
    w = Window.orderBy(F.desc("df"), "term")
    return top.withColumn("id", (F.row_number().over(w) - 1).cast("int"))


def bag_of_words(df: DataFrame, tokens: str, dictionary: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id, id, n): token counts per document over the dictionary (a
    bounded table, broadcast)."""
    ex = df.select(key, F.explode(tokens).alias("term"))
    j = ex.join(F.broadcast(dictionary.select("term", "id")), "term")
    return j.groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- priors --

def alpha_prior(alpha, k: int):
    """gensim-style priors: 'symmetric' = 1/k; 'asymmetric' proportional to
    1/(i + sqrt(k)), normalised; a number is used for every topic."""
    if alpha == "symmetric":
        return [1.0 / k] * k
    if alpha == "asymmetric":
        raw = [1.0 / (i + math.sqrt(k)) for i in range(k)]
        s = sum(raw)
        return [x / s for x in raw]
    return [float(alpha)] * k


def eta_prior(eta, k: int) -> float:
    if eta == "symmetric":
        return 1.0 / k
    return float(eta)


# -------------------------------------------------------------- coherence --

def window_counts(texts: DataFrame, tokens: str, topwords, window: int) -> DataFrame:
    """(a, b, n): over all sliding windows of all texts, the number of
    windows holding word a (rows a = b), holding both a and b (a < b), and
    the number of windows (a, b NULL).

    A top word at place p is in the windows that start in a range around p.
    The starts of a text are cut into blocks of 64; in a block a word's ranges
    are the bits of one number, united by ``bit_or``, and two words share the
    windows whose bits both have.  So a text costs its places and, per block,
    the pairs of words that occur there."""
    top = sorted(set(topwords))
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(tokens).alias("_t"))
    size = F.coalesce(F.size("_t"), F.lit(0))
    last = F.greatest(F.when(size < 0, 0).otherwise(size) - window, F.lit(0))  # where the last window starts
    total = rows.select((last + 1).alias("n")).agg(F.sum("n").alias("n"))
    each = rows.select("_row", last.alias("last"), F.posexplode("_t").alias("p", "w"))
    if len(top) <= LITERAL_TERMS:
        each = each.where(F.col("w").isin(top))
    else:  # the top words of many models
        each = each.join(texts.sparkSession.createDataFrame([(w,) for w in top], "w string"), "w", "left_semi")
    places = each.select("_row", "w", F.greatest(F.col("p") - window + 1, F.lit(0)).alias("lo"), F.least("p", "last").alias("hi"))
    blocks = (places.select("_row", "w", "lo", "hi", F.explode(F.sequence(F.expr("lo div 64"), F.expr("hi div 64"))).alias("block"))
              .select("_row", "block", "w", F.greatest(F.col("lo") - F.col("block") * 64, F.lit(0)).cast("int").alias("lo"),
                      F.least(F.col("hi") - F.col("block") * 64, F.lit(63)).cast("int").alias("hi"))
              .select("_row", "block", "w", F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (hi - lo)), lo)").alias("bits"))
              .repartition("_row", "block"))  # one exchange serves both groupings
    words = (blocks.groupBy("_row", "block", "w").agg(F.bit_or("bits").alias("bits"))
             .groupBy("_row", "block").agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("m")))
    pairs = (words.select("m", F.posexplode("m").alias("i", "x"))
             .select("x", F.explode(F.slice("m", F.col("i") + 1, F.size("m"))).alias("y"))
             .select(F.col("x.w").alias("a"), F.col("y.w").alias("b"), F.bit_count(F.col("x.bits").bitwiseAND(F.col("y.bits"))).alias("n"))
             .where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n")))
    nothing = F.lit(None).cast("string")
    return total.select(nothing.alias("a"), nothing.alias("b"), "n").unionByName(pairs)


def coherence_cv(texts: DataFrame, tokens: str, topics: DataFrame, window: int = L.COHERENCE_WINDOW) -> DataFrame:
    """c_v coherence per topic: (topic, coherence).

    ``topics`` is (topic, term): each topic's top words (a small table).
    Windows slide over every text; probabilities are window frequencies;
    each word's NPMI vector over its topic's words is compared by cosine
    with the topic's summed vector; the per-topic value is the mean over
    words (Roeder et al. 2015)."""
    topics = cut_lineage(topics.select("topic", "term"))  # read several times, and may be made from all texts
    tw = [r["term"] for r in topics.select("term").distinct().collect()]
    counts = window_counts(texts, tokens, tw, window).cache()
    total = counts.filter(F.col("a").isNull()).first()["n"]
    single = counts.filter(F.col("a").isNotNull() & (F.col("a") == F.col("b"))).select(
        F.col("a").alias("w"), F.col("n").alias("n_w"))
    pairs = counts.filter(F.col("a") < F.col("b")).select("a", "b", F.col("n").alias("n_ab"))
    t1 = topics.select("topic", F.col("term").alias("wi"))
    t2 = topics.select("topic", F.col("term").alias("wj"))
    ww = t1.join(t2, "topic")  # |topic|^2 rows per topic, bounded by the top-N setting
    ww = (ww.join(single.select(F.col("w").alias("wi"), F.col("n_w").alias("n_i")), "wi", "left")
          .join(single.select(F.col("w").alias("wj"), F.col("n_w").alias("n_j")), "wj", "left")
          .join(pairs.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "n_ab"),
                (F.least("wi", "wj") == F.col("lo")) & (F.greatest("wi", "wj") == F.col("hi")), "left"))
    n_ij = F.when(F.col("wi") == F.col("wj"), F.col("n_i")).otherwise(F.coalesce("n_ab", F.lit(0)))
    p_ij = n_ij / F.lit(total) + F.lit(EPSILON)
    p_i = F.col("n_i") / F.lit(total)
    p_j = F.col("n_j") / F.lit(total)
    npmi = F.log(p_ij / (p_i * p_j)) / (-F.log(p_ij))
    m = ww.select("topic", "wi", "wj", npmi.alias("v"))
    vsum = m.groupBy("topic", "wj").agg(F.sum("v").alias("s"))
    mj = m.join(vsum, ["topic", "wj"])
    per_word = mj.groupBy("topic", "wi").agg(
        (F.sum(F.col("v") * F.col("s")) / (F.sqrt(F.sum(F.col("v") ** 2)) * F.sqrt(F.sum(F.col("s") ** 2))))
        .alias("cos"))
    return per_word.groupBy("topic").agg(F.avg("cos").alias("coherence"))


# -------------------------------------------------------------- relevance --

def topic_relevance(topic_terms: DataFrame, term_freq: DataFrame, lam: float = 0.6,
                    top_n: int = L.TOPIC_TERMS_N) -> DataFrame:
    """(topic, term, p_wt, lift, relevance, rank): relevance =
    lam*log p(w|t) + (1-lam)*log(p(w|t)/p(w)) (Sievert & Shirley 2014); the
    ``top_n`` terms per topic by relevance.  ``topic_terms`` is (topic, term,
    weight) with any non-negative weights; ``term_freq`` is (term, n)."""
    tot = topic_terms.groupBy("topic").agg(F.sum("weight").alias("tw"))
    n_all = float(term_freq.agg(F.sum("n")).first()[0])  # a scalar, not a join
    pt = topic_terms.join(tot, "topic").withColumn("p_wt", F.col("weight") / F.col("tw"))
    pw = term_freq.select("term", (F.col("n") / F.lit(n_all)).alias("p_w"))
    j = pt.join(pw, "term")
    lift = F.col("p_wt") / F.col("p_w")
    rel = F.lit(lam) * F.log("p_wt") + F.lit(1 - lam) * F.log(lift)
    r = j.select("topic", "term", "p_wt", lift.alias("lift"), rel.alias("relevance"))
    w = Window.partitionBy("topic").orderBy(F.desc("relevance"), "term")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


# -------------------------------------------------------------- topic map --

def topic_distances(topic_terms: DataFrame) -> DataFrame:
    """(a, b, distance) for each two topics a < b: the Jensen-Shannon divergence
    of their term weights (natural logarithm, at most ln 2).  Only terms that
    both topics hold are joined; all other mass counts in full."""
    total = topic_terms.groupBy("topic").agg(F.sum("weight").alias("tw"))
    p = topic_terms.join(total, "topic").select("topic", "term", (F.col("weight") / F.col("tw")).alias("p")).where("p > 0")
    x = p.select(F.col("topic").alias("a"), "term", F.col("p").alias("pa"))
    y = p.select(F.col("topic").alias("b"), "term", F.col("p").alias("pb"))
    part = lambda v: 0.5 * F.col(v) * F.log(F.col(v) / (F.col("pa") + F.col("pb")))
    met = x.join(y, "term").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(part("pa") + part("pb")).alias("s"))
    names = sorted(r["topic"] for r in topic_terms.select("topic").distinct().collect())  # a row per topic
    kind = dict(topic_terms.dtypes)["topic"]
    both = topic_terms.sparkSession.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1:]], f"a {kind}, b {kind}")
    return both.join(met, ["a", "b"], "left").select("a", "b", (F.lit(math.log(2)) + F.coalesce("s", F.lit(0.0))).alias("distance"))


def topic_map(topic_terms: DataFrame) -> DataFrame:
    """(topic, x, y, share): the topics in the plane by classical scaling of
    their distances (a matrix of topics by topics, on the driver), and the share
    of all weight that each holds."""
    import numpy as np
    shares = topic_terms.groupBy("topic").agg(F.sum("weight").alias("w")).orderBy("topic").collect()  # a row per topic
    names = [r["topic"] for r in shares]
    at = {t: i for i, t in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in topic_distances(topic_terms).collect():
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = max(r["distance"], 0.0)
    xy = classical_scaling(d)
    whole = sum(r["w"] for r in shares)
    rows = [(t, float(xy[i, 0]), float(xy[i, 1]), float(shares[i]["w"] / whole)) for i, t in enumerate(names)]
    kind = dict(topic_terms.dtypes)["topic"]
    return topic_terms.sparkSession.createDataFrame(rows, f"topic {kind}, x double, y double, share double")


def classical_scaling(d, dims: int = 2):
    """Points whose distances come nearest to the matrix ``d``; each axis is
    turned so that its largest coordinate is positive."""
    import numpy as np
    n = len(d)
    out = np.zeros((n, dims))
    if n < 2:
        return out
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    for k in range(min(dims, n)):
        v = vectors[:, -1 - k]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        out[:, k] = v * np.sqrt(max(values[-1 - k], 0.0))
    return out
