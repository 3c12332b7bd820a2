"""Token ids in binary shards, with a minimal perfect hash index over them.

Writing: documents are range-partitioned and sorted by id, each partition
encodes its texts and writes one shard file.  A shard file is a header of
``HEADER`` bytes (the magic, the version) and the raw ids, 16 bits each,
little-endian; a document's ids end with ``END``.  A file appears under its
final name by one rename, so a task that runs again replaces it by the same
bytes.

Index: keys (document id, number among the rows with this id) are dealt into
buckets by hash.  Per bucket a minimal perfect hash is built of bit levels: a
key's bit of a level is set if no other key shares it, else the key goes on to
the next level; the rank of its bit is its slot.  Slots hold a fingerprint,
the shard, the offset in it, the number of ids and the number of ids before
the document.  A lookup takes a few bit tests, one rank, one comparison of
fingerprints and one read: constant time, whatever the corpus holds.

Null texts are empty and yield the end id alone.  Rows with a null id come
first; repeated ids are kept apart by their number, in the order of a hash of
their text.
"""

from __future__ import annotations

import gc
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .bpe import encoder, vocabulary_path
from .common import grouped, mix, register, slices, table, written

MAGIC = b"TLTOKEN\x01"
HEADER = 16
END = 0
BUCKET_KEYS = 50_000
#: Bytes of text that a shard holds about, at least and at most.
SHARD_LEAST, SHARD_MOST = 4 << 20, 512 << 20
#: Bits per key of a level.
ROOM = 2
LEVELS = 64


def file_system(path: str):
    """The file system of a path in the cluster's notation, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)))


def shard_count(size: int, wanted: int) -> int:
    """Shards of a corpus of ``size`` bytes of text: ``wanted``, unless they
    would hold more or less than they should."""
    return max(1, min(max(wanted, -(-size // SHARD_MOST)), -(-size // SHARD_LEAST)))


def shard_name(shard: int) -> str:
    return f"ids-{shard:06d}.bin"


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Encode and write all documents; returns (doc_id, number, shard, offset,
    n_tokens) for each, written beside the shards."""
    vocabulary = vocabulary or vocabulary_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = shard_count(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        encode = encoder(vocabulary).encode
        end = np.asarray([END], "<u2").tobytes()
        shard = TaskContext.get().partitionId()
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        draft, offset, last, number, out = f"{folder}/.{shard_name(shard)}.{uuid.uuid4().hex}", 0, None, 0, None
        gc.disable()  # millions of short-lived lists without cycles
        try:
            for whole in batches:
                for batch in slices(whole, "text"):
                    if out is None:
                        out = system.open_output_stream(draft)
                        out.write(MAGIC.ljust(HEADER, b"\0"))
                    ids = batch.column("doc_id").to_pylist()
                    numbers, offsets, counts = [], [], []
                    for i, text in zip(ids, batch.column("text").to_pylist()):
                        number = number + 1 if (i, 1) == last else 0
                        last = (i, 1)
                        data = encode(text) + end
                        out.write(data)
                        numbers.append(number)
                        offsets.append(offset)
                        counts.append(len(data) // 2)
                        offset += len(data) // 2
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array([shard] * len(ids), pa.int32()),
                         pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())],
                        names=["doc_id", "number", "shard", "offset", "n_tokens"])
            if out is not None:
                out.close()
                out = None
                system.move(draft, f"{folder}/{shard_name(shard)}")
        finally:
            gc.enable()
            if out is not None:
                out.close()
                system.delete_file(draft)

    return written(rows.mapInArrow(write, "doc_id long, number long, shard int, offset long, n_tokens long"), "manifest")


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """A minimal perfect hash of distinct keys (a row of 64-bit values each, or
    one value): the sizes of its levels and all their bits."""
    sizes, bits = [], []
    rest = keys
    for level in range(LEVELS):
        if not len(rest):
            break
        size = ROOM * len(rest) + 63
        at = _spot(rest, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        rest = rest[~alone[at]]
    if len(rest):
        raise ValueError("a key is there twice")
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def _folded(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each key under a salt."""
    salt = np.uint64(salt & (1 << 64) - 1)
    out = np.full(len(keys), salt)
    for value in keys.reshape(len(keys), -1).T:
        out = mix(out + value)
    return out


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_folded(keys, (level + 1) * 0x9E3779B97F4A7C15) % np.uint64(size)).astype(np.int64)


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Each key's slot, or -1 if no level has a bit for it."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    slot = np.full(len(keys), -1, np.int64)
    open_, start = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = start + _spot(keys[open_], level, size)
        hit = bits[at]
        slot[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + size
    return slot


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_folded(keys, 0xA0761D6478BD642F) >> np.uint64(32)).astype("<u4")


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with their bucket; the key is the id and the number themselves
    (the number's lowest bit marks a null id), so no two keys are alike."""
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(0))).withColumn("key2", F.col("number") * 2 + F.col("doc_id").isNull().cast("long"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key", "key2"), F.lit(buckets)).cast("int"))


def _keys(part: pa.Table) -> np.ndarray:
    return np.stack([part.column(c).to_numpy() for c in ("key", "key2")], axis=1).view(np.uint64)


def build_index(manifest: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """The index, one row per bucket, and the number of buckets."""
    totals = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("docs")).orderBy("shard").collect()
    before = dict(zip([r["shard"] for r in totals], np.cumsum([0] + [r["ids"] for r in totals]).tolist()))
    buckets = max(1, -(-sum(r["docs"] for r in totals) // bucket_keys))

    def build(batches):
        for bucket, part in grouped(batches, "bucket"):
            keys = _keys(part)
            sizes, bits = build_hash(keys)
            order = np.argsort(find_slots(keys, sizes, bits))
            shard, offset, count = (part.column(c).to_numpy()[order] for c in ("shard", "offset", "n_tokens"))
            start = offset + np.asarray([before[s] for s in shard.tolist()], np.int64)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([bucket], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "bits": [np.packbits(bits).tobytes()], "fingerprints": [_fingerprint(keys[order]).tobytes()],
                "shards": [shard.astype("<u4").tobytes()], "offsets": [offset.astype("<u8").tobytes()],
                "counts": [count.astype("<u8").tobytes()], "starts": [start.astype("<u8").tobytes()]})

    rows = _keyed(manifest, buckets).select("bucket", "key", "key2", "shard", "offset", "n_tokens").repartition("bucket").sortWithinPartitions("bucket")
    return written(rows.mapInArrow(build, "bucket int, sizes array<long>, bits binary, fingerprints binary, shards binary, "
                                          "offsets binary, counts binary, starts binary"), "index"), buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, number, shard, offset, n_tokens, start) of the keys (doc_id,
    number) that the index holds."""

    def find(_, wanted: pa.Table, held: pa.Table) -> pa.Table:
        cols = {"shard": ("shards", "<u4", pa.int32()), "offset": ("offsets", "<u8", pa.int64()),
                "n_tokens": ("counts", "<u8", pa.int64()), "start": ("starts", "<u8", pa.int64())}
        if not held.num_rows or not wanted.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "number": pa.array([], pa.int64()), **{c: pa.array([], k) for c, (_, _, k) in cols.items()}})
        row = held.slice(0, 1).to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:sum(row["sizes"])].astype(bool)
        key = _keys(wanted)
        slot = find_slots(key, row["sizes"], bits)
        stored = np.frombuffer(row["fingerprints"], "<u4")
        good = np.flatnonzero((slot >= 0) & (stored[slot] == _fingerprint(key)))
        slot = slot[good]
        take = pa.array(good)
        return pa.table({"doc_id": wanted.column("doc_id").take(take), "number": wanted.column("number").take(take),
                         **{c: pa.array(np.frombuffer(row[name], kind)[slot].astype(np.int64)).cast(out) for c, (name, kind, out) in cols.items()}})

    wanted = _keyed(keys, buckets).select("bucket", "key", "key2", "doc_id", "number")
    return (wanted.groupBy("bucket").cogroup(index.groupBy("bucket"))
            .applyInArrow(find, "doc_id long, number long, shard int, offset long, n_tokens long, start long"))


def read_ids(found: DataFrame, path: str) -> DataFrame:
    """Read the documents that ``look_up`` found: (doc_id, start, n_tokens, ids_crc32)."""

    def read(batches):
        system, folder = file_system(path)
        for shard, part in grouped(batches, "shard"):
            with system.open_input_file(f"{folder}/{shard_name(shard)}") as f:
                if f.read(len(MAGIC)) != MAGIC:
                    raise ValueError(f"shard {shard} is not a file of token ids")
                crc = []
                for offset, n in zip(part.column("offset").to_pylist(), part.column("n_tokens").to_pylist()):
                    f.seek(HEADER + 2 * offset)
                    crc.append(zlib.crc32(np.frombuffer(f.read(2 * n), "<u2").astype("<u4").tobytes()))
            yield from pa.table({"doc_id": part.column("doc_id"), "start": part.column("start"), "n_tokens": part.column("n_tokens"),
                                 "ids_crc32": pa.array(crc, pa.int64())}).combine_chunks().to_batches()

    rows = found.repartition("shard").sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Write all documents, index them, look every key up and read it back."""
    path = scratch_path(docs.sparkSession, "shards")
    manifest = write_shards(docs, path, id_col)
    index, buckets = build_index(manifest)
    return read_ids(look_up(manifest.select("doc_id", "number"), index, buckets), path)


@register("op5_token_index")
def op5_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
