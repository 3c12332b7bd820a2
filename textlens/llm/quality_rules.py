"""Quality rules: a hashed n-gram logistic regression with fixed thresholds.

Word unigrams and bigrams and character 3- and 5-grams (of UTF-8 bytes) are
hashed to one weight table.  A document's feature vector holds, per family,
the share of each bucket among the family's n-grams, so length alone never
decides.  The regression is trained on a bounded sample of labelled rows
(``max_rows`` of each class, the smallest hashes of the id), its probabilities
are calibrated on a part of that sample it was not trained on (Platt's
scaling, each row weighted by the labelled rows that it stands for, so the
bound does not move the threshold), and Arrow batches of documents are scored against fixed thresholds.

Null texts count as empty; empty texts have no words and fail the base rules.
If the labels hold fewer than two classes, the model keeps whatever passes the
base rules.  Columns of the input called like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import as_bytes, free_name, label_counts, labelled_sample, mix, register, slices, table, window_hashes, word_hashes

BITS = 16
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: A document is kept from this calibrated probability of good quality on.
KEEP_PROBABILITY = 0.3
#: Labelled rows of each class that the model may be trained on.
MAX_ROWS = 1000

SYMBOLS = b"#*$%&|<>"
FAMILIES = 4
FIELDS = [StructField("n_words", LongType()), StructField("word_chars", LongType()),
          StructField("n_symbols", LongType()), StructField("n_dup_lines", LongType()),
          StructField("n_repeat_words", LongType()), StructField("base_failed", BooleanType()),
          StructField("probability", DoubleType()), StructField("kept", BooleanType())]


def repeated_words(h: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words lying in a window of ``window`` words that the text has twice or more."""
    w = window_hashes(h, window)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def buckets(text: bytes, h: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of each family's n-grams."""
    shift = np.uint64(64 - BITS)
    out = [(mix(h) >> shift).astype(np.int32), (window_hashes(h, 2) >> shift).astype(np.int32)]
    b = np.frombuffer(text, np.uint8)
    two = b[:-1].astype(np.uint32) | (b[1:].astype(np.uint32) << np.uint32(8))
    three = two[:-1] | (b[2:].astype(np.uint32) << np.uint32(16))
    down = np.uint32(32 - BITS)
    out.append(((three * np.uint32(0x9E3779B1)) >> down).astype(np.int32))
    five = (three[:-2] * np.uint32(0x85EBCA77)) ^ (two[3:] * np.uint32(0xC2B2AE3D))
    out.append((((five ^ (five >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> down).astype(np.int32))
    return out


@dataclass
class QualityModel:
    """Weights over hashed n-grams, and the two numbers of the calibration."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    trained: bool = True

    def margin(self, text: bytes, h: np.ndarray) -> float:
        total = self.bias
        for idx in buckets(text, h):
            if len(idx):
                total += float(self.weights.take(idx).mean())
        return total

    def probability(self, margin: float) -> float:
        if not self.trained:
            return 1.0
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def _sparse(batches):
    """Sample rows as sparse feature vectors."""
    for batch in batches:
        out = {"_id": [], "_y": [], "idx": [], "val": []}
        for i, y, text in zip(batch.column("_id").to_pylist(), batch.column("_y").to_pylist(), as_bytes(batch.column("_text"))):
            idx, val = [], []
            for b in buckets(text, word_hashes(text.split())):
                if len(b):
                    at, n = np.unique(b, return_counts=True)
                    idx.append(at)
                    val.append(n / len(b))
            out["_id"].append(i)
            out["_y"].append(y)
            out["idx"].append(np.concatenate(idx).astype(np.int32).tobytes() if idx else b"")
            out["val"].append(np.concatenate(val).astype(np.float32).tobytes() if val else b"")
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("_id", pa.int64()), ("_y", pa.int32()), ("idx", pa.binary()), ("val", pa.binary())]))


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The bytes of a binary column's rows, one after the other, as numbers
    (in place: the sample's features are not copied)."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(kind)


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's scaling of weighted rows by Newton steps, with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        grad = x.T @ (weight * (p - target))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS,
                rounds: int = 40, l2: float = 1e-5) -> QualityModel:
    """Train on at most ``max_rows`` rows of each class; every fourth of them
    (by hash) is held back for the calibration, in which each class counts as
    it does among all labels."""
    rows = (labelled_sample(docs, labels, label, max_rows)
            .mapInArrow(_sparse, "_id long, _y int, idx binary, val binary").toArrow().sort_by("_id"))
    y = rows.column("_y").to_numpy().astype(np.float64)
    weights = np.zeros(1 << BITS, np.float64)
    if len(set(y.tolist())) < 2:
        return QualityModel(weights.astype(np.float32), trained=False)
    held = np.asarray([int(mix(np.asarray([i], np.uint64))[0] % np.uint64(4)) == 0 for i in rows.column("_id").to_pylist()])
    col, x = _joined(rows.column("idx"), np.int32), _joined(rows.column("val"), np.float32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(pc.binary_length(rows.column("idx"))) // 4)

    def margins(w, b):
        return b + np.bincount(row, weights=w[col] * x, minlength=len(y))

    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    fit = ~held
    share = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit
    b, gw, gb, rate = 0.0, np.full(1 << BITS, 1e-12), 1e-12, 4.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margins(weights, b), -30, 30)))
        err = (p - y) * share
        g = np.bincount(col, weights=err[row] * x, minlength=1 << BITS) + l2 * weights
        gw += g * g
        gb += err.sum() ** 2
        weights -= rate * g / np.sqrt(gw)
        b -= 0.1 * rate * err.sum() / np.sqrt(gb)
    weights = weights.astype(np.float32)
    use = held if held.any() else fit
    of = label_counts(labels, label)
    weight = np.where(y == 1, max(1.0, of.get(1, 0) / max_rows), max(1.0, of.get(0, 0) / max_rows))[use]
    slope, offset = _platt(margins(weights.astype(np.float64), b)[use], y[use], weight / weight.mean())
    return QualityModel(weights, float(b), slope, offset)


def score_quality(docs: DataFrame, model: QualityModel, keep: float = KEEP_PROBABILITY) -> DataFrame:
    """All rows and columns of ``docs``, and the columns of ``FIELDS``."""
    names = {f.name for f in FIELDS}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(docs.schema.fields + FIELDS)

    def score(batches):
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                out = [[] for _ in FIELDS]
                for text in as_bytes(batch.column("text")):
                    text = text or b""
                    words = text.split()
                    h = word_hashes(words)
                    joined = b"".join(words)
                    repeat = repeated_words(h)
                    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
                    p = model.probability(model.margin(text, h))
                    for at, v in zip(out, (len(words), len(joined.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)),
                                           duplicate_lines(text), repeat, failed, p, not failed and p >= keep)):
                        at.append(v)
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(v, k) for v, k in zip(out, kinds))],
                    names=[*batch.schema.names, *(f.name for f in FIELDS)])

    return docs.mapInArrow(score, schema)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    text, row = free_name(docs, "text_"), free_name(docs, "row_")
    packed = docs.select(F.struct("*").alias(row), F.col("text").alias(text)).withColumnRenamed(text, "text")
    return score_quality(packed, model).where("kept").select(f"{row}.*")


@register("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "probability")
