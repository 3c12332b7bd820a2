"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

#: The word pattern of the contracts: runs without blank, tab, line feed,
#: vertical tab, form feed and carriage return.  ``bytes.split()`` splits on
#: exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\r\x0b\x0c"

#: Bytes of text that a task looks at in one go.
SLICE_BYTES = 8 << 20


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder of the
    cluster and read it back.  The files survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned; nothing that is
    still to be computed may read it."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def as_bytes(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each of at most ``limit`` bytes of ``column`` or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen before by this process (bounded)."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of the xor-shift kind)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each window of ``k`` values; none if there are fewer."""
    n = len(h) - k + 1
    if n < 1:
        return h[:0]
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i:i + n]
    return mix(out)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal ``key`` in sorted batches, one table each."""
    held: list[pa.RecordBatch] = []
    last: object = None
    for batch in batches:
        keys = batch.column(key)
        if batch.num_rows == 0:
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _one_label(labels: DataFrame, label: str, id_col: str, keep=None) -> DataFrame:
    """(id, _y): each labelled id with its larger label."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        lab = lab.where(keep)
    return lab.groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))


def label_counts(labels: DataFrame, label: str, id_col: str = "doc_id") -> dict[int, int]:
    """The number of ids of each label, by the rules of ``labelled_sample``."""
    return {r["_y"]: r["count"] for r in _one_label(labels, label, id_col).groupBy("_y").count().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int,
                    id_col: str = "doc_id", keep=None) -> DataFrame:
    """At most ``rows`` labelled rows of each value of ``label``, those whose id
    has the smallest hash, with their text.  The sample's ids are a table of
    at most ``2 * rows`` rows, small enough to broadcast by that bound; rows of
    null id or label are left out, an id with two labels takes the larger."""
    lab = _one_label(labels, label, id_col, keep)
    parts = []
    for v in (0, 1):
        part = (lab.where(F.col("_y") == v)
                .orderBy(F.xxhash64(id_col), id_col).limit(rows))
        parts.append(part)
    chosen = parts[0].unionByName(parts[1]).withColumnRenamed(id_col, "_id")
    text = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return text.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_text", "_y")
