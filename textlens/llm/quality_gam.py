"""Quality classifier: a generalised additive model with pairwise interactions.

A text is described by the numbers of ``FEATURES``.  Each feature is cut into
bins at quantiles of the training rows; the model holds a table of values per
feature and per chosen pair of features, and a text's log-odds are the sum of
the values of its bins.  The tables are learned by cyclic boosting: in every
round each feature in turn fits a shallow tree over its bins to the current
gradients and adds a small part of it.  Then the pairs with the largest gain
on the residuals are boosted likewise, with trees that cut both features.

Training takes at most ``max_rows`` labelled rows of each class (the smallest
hashes of the id), weighted back to the classes' counts among all labelled
rows.  Rows whose crc32(doc_id) mod 5 is 0 are held out.  Null and empty texts
have a score like any other; without labels of both classes the score is the
share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, labelled_sample, register, slices, table, window_hashes, word_hashes
from .quality_rules import SYMBOLS, duplicate_lines, repeated_words

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "stops", "marks", "dup_lines", "repeat_words",
            "distinct_words", "top_word", "distinct_pairs", "marked_words", "line_words", "stopped_lines", "beyond_ascii",
            "short_words", "entropy", "letter_runs")
BINS = 48
ROUNDS, PAIR_ROUNDS = 150, 60
RATE = 0.1
LEAVES = 4
PAIRS = 6
MAX_ROWS = 4000
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def describe(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    h = word_hashes(words)
    counts = np.unique(h, return_counts=True)[1]
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = byte[_UPPER].sum(), byte[_LOWER].sum()
    share = byte[byte > 0] / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = window_hashes(h, 2)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    plain = _LOWER | _UPPER | _DIGIT
    plain = plain[last] | (last >= 128)
    codes = np.frombuffer(text, np.uint8)
    return [
        np.log1p(n), (size - byte[[32, 10, 9, 13, 11, 12]].sum()) / n, sum(byte[c] for c in SYMBOLS) / size,
        upper / max(1, upper + lower), byte[_DIGIT].sum() / size, byte[46] / n, (byte[33] + byte[63]) / n,
        duplicate_lines(text) / len(lines), repeated_words(h) / n, len(counts) / n, counts.max() / n,
        len(np.unique(pairs)) / max(1, len(pairs)), 1 - plain.mean(), np.log1p(n / len(lines)),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), byte[128:].sum() / size,
        sum(len(w) == 1 for w in words) / n, float(-(share * np.log2(share)).sum()),
        float((codes[1:] == codes[:-1]).mean()) if size > 1 else 0.0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class AdditiveModel:
    """Tables of values over bins, and what they add up on."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.cuts:
            at = self.bins(x)
            for b, t in zip(at, self.tables):
                total += t[b]
            for (i, j), g in zip(self.pairs, self.grids):
                total += g[at[i], at[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES, ridge: float = 1.0) -> np.ndarray:
    """Of the bins' gradient sums ``g`` and hessian sums ``h``, the values of a
    tree with at most ``leaves`` leaves, each a range of bins."""

    def best(a: int, b: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left = gl[:-1] ** 2 / (hl[:-1] + ridge)
        right = (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + ridge)
        if not len(left):
            return 0.0, a
        gain = left + right - gl[-1] ** 2 / (hl[-1] + ridge)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    parts = {(0, len(g)): best(0, len(g))}
    while len(parts) < leaves:
        (a, b), (gain, cut) = max(parts.items(), key=lambda p: p[1][0])
        if gain <= 1e-9:
            break
        del parts[a, b]
        parts[a, cut], parts[cut, b] = best(a, cut), best(cut, b)
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def crossed_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """A tree of four leaves over a grid of bins: the best cut of one feature
    and the best cut of the other on either side; and its gain."""
    best = (0.0, None)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        top_g, top_h = np.cumsum(a, 0), np.cumsum(b, 0)
        for k in range(a.shape[0] - 1):
            gain, cuts = -whole, []
            for x, y in ((top_g[k], top_h[k]), (top_g[-1] - top_g[k], top_h[-1] - top_h[k])):
                gl, hl = np.cumsum(x), np.cumsum(y)
                v = gl ** 2 / (hl + ridge) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + ridge)
                cuts.append(int(v.argmax()))
                gain += float(v.max())
            if gain > best[0]:
                best = (gain, (axis, k, cuts))
    out = np.zeros(g.shape)
    if best[1]:
        axis, k, cuts = best[1]
        view, a, b = (out, g, h) if axis == 0 else (out.T, g.T, h.T)
        for rows, cut in ((slice(0, k + 1), cuts[0]), (slice(k + 1, None), cuts[1])):
            for cols in (slice(0, cut + 1), slice(cut + 1, None)):
                view[rows, cols] = -a[rows, cols].sum() / (b[rows, cols].sum() + ridge)
    return out, best[0]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the tables, then of the pairs' grids."""
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    model = AdditiveModel(float(np.log(share / (1 - share))))
    model.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    at = model.bins(x)
    size = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(n) for n in size]
    margin = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(at):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b, g, size[j]), np.bincount(b, h, size[j]))
            model.tables[j] += step
            margin += step[b]

    def grid(i, j, v):
        return np.bincount(at[i] * size[j] + at[j], v, size[i] * size[j]).reshape(size[i], size[j])

    g, h = slopes()
    gains = sorted(((crossed_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(len(size)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 1e-6]
    model.grids = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS if model.pairs else 0):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * crossed_tree(grid(i, j, g), grid(i, j, h))[0]
            model.grids[k] += step
            margin += step[at[i], at[j]]
    for t in model.tables:  # tables are centred, the base takes their means
        t -= t.mean()
    p = model.score(x)
    model.base += float(np.log(share / (1 - share)) - np.log(((weight * p).sum() / weight.sum()) / (1 - (weight * p).sum() / weight.sum())))
    return model


def fit_gam(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, keep: Column | None = None) -> AdditiveModel:
    """Train on labelled rows for which ``keep`` holds (default: not held out)."""
    keep = ~held_out(F.col("doc_id")) if keep is None else keep

    def features(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                x = np.asarray([describe(t) for t in as_bytes(batch.column("_text"))], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_id", "_y", "x"])

    of = {r["y"]: r["n"] for r in labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
          .groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        share = np.clip(next(iter(of), 0.5), 0.02, 0.98)
        return AdditiveModel(float(np.log(share / (1 - share))))
    rows = labelled_sample(docs, labels, label, max_rows, keep=keep).mapInArrow(features, "_id long, _y int, x array<double>").toArrow().sort_by("_id")
    y = rows.column("_y").to_numpy().astype(np.float64)
    x = np.asarray(rows.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    if len(set(y.tolist())) < 2:
        return AdditiveModel(float(np.log(of[1] / of[0])))
    n = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, of[1] / n[1], of[0] / n[0])
    return train(x, y, weight / weight.mean())


def score_gam(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of each row of ``docs`` (columns ``id_col`` and ``text``)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), "text")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = np.asarray([describe(t or b"") for t in as_bytes(batch.column("text"))], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


@register("op6_quality_gam")
def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_gam(docs, table(spark, sf_dir, "labels"))
    return score_gam(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
