"""Packing: harmonic classes of reciprocal capacities, a fixed number of pieces a
sequence.

A piece of r tokens belongs to class k = SIZE // r (its length lies between
SIZE / (k + 1) and SIZE / k), and k pieces of class k fill a sequence.  A
document is cut into pieces of SIZE tokens and a rest; the rest stays whole if
k pieces of its length leave at most SLACK tokens of a sequence empty, else a
piece of exactly SIZE // (k + 1) tokens is cut off it and what remains is
looked at again.  A full sequence of class k leaves at most SLACK tokens empty,
or fewer than k where pieces of SIZE // k tokens do not divide SIZE.

1. Each task encodes its documents and keeps one open sequence per class; one
   that has its k pieces is written at once.  Nothing is shuffled for them.
2. At the end of a task each class has fewer than k pieces left.  They are
   numbered through per class (a count per task and class, summed up in the
   order of the tasks) and every k of them make a sequence.
3. Fewer than k pieces per class are left over all: their number is bounded by
   the classes (some ten thousand pieces at most, of 200,000 tokens), whatever
   the input holds.  One task lines them up and cuts the line into sequences of
   SIZE tokens, the end of it into powers of two, which need no padding.

A sequence is padded with PAD to SIZE, except one whose tokens come to a power
of two.  Sequences are rows of a table: their number, ids (16 bits each,
little-endian, padding included) and pieces.

Null and empty texts hold the end id alone.  Repeated rows and ids are packed
each time they occur; a null id stays null; an empty table gives no sequences.
Long texts are encoded part by part.  Which pieces meet depends on how the
input's files are split; with the same splits reruns agree.
"""

from __future__ import annotations

import gc
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary_path
from .common import as_bytes, register, slices, table, written

VOCABULARY = "word_bpe_49k.json"
END, PAD = 1, 0
#: Tokens of a sequence (a power of two).
SIZE = 2048
#: Empty tokens that a sequence of equal pieces may have for them to stay whole.
SLACK = 24
#: Parts of texts, and pieces of parts, whose ids a process keeps.
CACHE, PIECE_CACHE = 300_000, 500_000
#: The pattern of the vocabulary's pre-tokenizer (fixed values).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: A word of plain letters and the signs after it (no apostrophe): two pieces.
_PLAIN = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
#: Visible characters that lower case and composition treat alike everywhere.
_LATIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*")

PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                   ("offset", pa.int64())])
PACKED = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(PIECE)),
                    ("class", pa.int32()), ("task", pa.int32()), ("number", pa.int64())])
PIECE_SQL = "struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>"
PACKED_SQL = f"sequence_id long, ids binary, pieces array<{PIECE_SQL}>, class int, task int, number long"


class Pieces(dict):
    """A piece that the vocabulary's pattern cuts (lower case) -> its ids."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.letters = byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        spelled = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.letters)
        found = np.asarray([t.id for t in self.model.tokenize(spelled)], "<u2").tobytes()
        if len(self) < PIECE_CACHE and len(piece) < 64:
            self[piece] = found
        return found


class Words(dict):
    """A part of a text between white space -> its ids (little-endian, 16 bits).

    The vocabulary drops white space and no id reaches across it, so a text's
    ids are those of its parts.  Visible Latin parts are cut here into the
    pieces of the file's pattern, which repeat more often than parts do; all
    others go to the library.  (The tests compare with encoding texts whole.)"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.pieces = Pieces(self.tokenizer.model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = {a[0] for a in self.added}

    def __missing__(self, part: bytes) -> bytes:
        plain = _PLAIN.fullmatch(part)
        if plain:
            word, signs = plain.groups()
            found = self.pieces[word.lower()]
            if signs:
                found += self.pieces[signs]
        else:
            text = part.decode()
            if _LATIN.fullmatch(text) and (self.signs.isdisjoint(text) or not any(a in text for a in self.added)):
                found = b"".join([self.pieces[x.encode()] for x in _PIECES.findall(text.lower())])
            else:
                found = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self) < CACHE and len(part) < 64:
            self[part] = found
        return found

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(2)
def encoder(path: str) -> Words:
    return Words(path)


@lru_cache(4)
def cuts(size: int, slack: int) -> list[list[int]]:
    """For each rest below ``size`` the lengths of its pieces."""
    out: list[list[int]] = [[]]
    for r in range(1, size):
        k = size // r
        if size - k * r <= slack:
            out.append([r])
        else:
            first = size // (k + 1)
            out.append([first, *out[r - first]])
    return out


def lengths(n: int, size: int = SIZE, slack: int = SLACK) -> list[int]:
    """The lengths of the pieces of a document of ``n`` tokens."""
    return [size] * (n // size) + cuts(size, slack)[n % size]


def padded(ids: bytes, size: int) -> bytes:
    n = len(ids) // 2
    if n & (n - 1) == 0:
        return ids
    return ids + np.full(size - n, PAD, "<u2").tobytes()


def _fill(docs: DataFrame, size: int, slack: int, vocabulary: str, id_col: str) -> DataFrame:
    """Full sequences of each task and, with a null number, its last pieces."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def fill(batches):
        encode = encoder(vocabulary).encode
        end = np.asarray([END], "<u2").tobytes()
        task = TaskContext.get().partitionId()
        open_: dict[int, list] = {}
        done = 0
        gc.disable()  # millions of short-lived lists without cycles
        try:
            for whole in batches:
                for batch in slices(whole, "text"):
                    full = []
                    for i, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                        ids = encode(text) + end
                        n, start = len(ids) // 2, 0
                        for r in lengths(n, size, slack):
                            k = size // r
                            bin_ = open_.setdefault(k, [])
                            bin_.append((i, start, r, n, ids[2 * start:2 * (start + r)]))
                            start += r
                            if len(bin_) == k:
                                full.append(((task << 33) + done, bin_, None, None, None))
                                done += 1
                                open_[k] = []
                    yield _rows(full, size)
            yield _rows([(None, [piece], k, task, number) for k, bin_ in sorted(open_.items()) for number, piece in enumerate(bin_)], size)
        finally:
            gc.enable()

    return rows.mapInArrow(fill, PACKED_SQL)


def _rows(found: list, size: int) -> pa.RecordBatch:
    """Rows (sequence, pieces, class, task, number); a piece is (doc_id, start,
    length, doc_tokens, ids).  Ids of a numbered sequence are padded."""
    flat = [p for row in found for p in row[1]]
    ends = np.cumsum([0, *(len(row[1]) for row in found)])
    length = np.asarray([p[2] for p in flat], np.int64)
    before = np.concatenate([[0], np.cumsum(length)])[:-1]
    offset = before - np.repeat(before[ends[:-1]] if len(flat) else before[:0], np.diff(ends))
    ids = [b"".join(p[4] for p in row[1]) for row in found]
    pieces = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int64()), pa.array(length),
                                         pa.array([p[3] for p in flat], pa.int64()), pa.array(offset)], fields=list(PIECE))
    return pa.RecordBatch.from_arrays(
        [pa.array([row[0] for row in found], pa.int64()),
         pa.array([x if row[0] is None else padded(x, size) for row, x in zip(found, ids)], pa.binary()),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces),
         *[pa.array([row[c] for row in found], kind) for c, kind in ((2, pa.int32()), (3, pa.int32()), (4, pa.int64()))]], schema=PACKED)


def _line_up(pieces: list, size: int):
    """Pieces one after another, cut into sequences of ``size`` tokens, the end
    of the line into powers of two."""
    left = sum(p[2] for p in pieces)
    room, row = 0, []
    for i, start, r, n, ids in pieces:
        at = 0
        while at < r:
            if not room:
                room = size if left >= size else 1 << (left.bit_length() - 1)
            take = min(room, r - at)
            row.append((i, start + at, take, n, ids[2 * at:2 * (at + take)]))
            at, room, left = at + take, room - take, left - take
            if not room:
                yield row
                row = []


def pack(docs: DataFrame, id_col: str = "doc_id", size: int = SIZE, slack: int = SLACK, vocabulary: str | None = None) -> DataFrame:
    """All documents as sequences: (sequence_id, ids, pieces), written in the
    shared folder."""
    if size & (size - 1):
        raise ValueError("the size of a sequence is a power of two")
    filled = written(_fill(docs, size, slack, vocabulary or vocabulary_path(VOCABULARY), id_col), "sequences")
    rest = filled.where("sequence_id IS NULL")
    counts = rest.groupBy("class", "task").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("class", "task", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"),
                           F.sum("n").over(Window.partitionBy("class")).alias("total"))
    place = F.col("before") + F.col("number")
    placed = (rest.join(before, ["class", "task"])
              .select("class", ((place - place % F.col("class")) / F.col("class")).cast("long").alias("bin"), (place % F.col("class")).alias("number"),
                      (place >= F.col("total") - F.col("total") % F.col("class")).alias("over"),
                      F.element_at("pieces", 1).alias("piece"), "ids"))
    # Sequences from tasks are numbered below 1 << 62 (task << 33), merged ones by class above, the last line's above those.
    merged_from, line_from = 1 << 62, (1 << 62) + (1 << 61)

    def gather(key, part):
        part = part.sort_by([("class", "ascending"), ("number", "ascending")])
        pieces = [(p["doc_id"], p["start"], p["length"], p["doc_tokens"], ids)
                  for p, ids in zip(part.column("piece").to_pylist(), part.column("ids").to_pylist())]
        first = key[0].as_py()
        rows = enumerate(_line_up(pieces, size)) if first == line_from else [(0, pieces)]
        found = _rows([(first + j, row, None, None, None) for j, row in rows], size)
        return pa.Table.from_batches([found]).select(["sequence_id", "ids", "pieces"])

    sequence = F.when(F.col("over"), F.lit(line_from)).otherwise(
        F.lit(merged_from) + (F.col("class").cast("long") * (1 << 44)) + F.col("bin"))
    merged = written(placed.withColumn("sequence", sequence).groupBy("sequence")
                     .applyInArrow(gather, f"sequence_id long, ids binary, pieces array<{PIECE_SQL}>"), "merged")
    return filled.where("sequence_id IS NOT NULL").select("sequence_id", "ids", "pieces").unionByName(merged)


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece, its ids read back from its sequence."""

    def unpack(batches):
        for batch in batches:
            lists = batch.column("pieces")
            held, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            own = {f.name: held.field(i) for i, f in enumerate(held.type)}
            offset, length = own["offset"].to_numpy().tolist(), own["length"].to_numpy().tolist()
            crc, at = [], 0
            for ids, n in zip(batch.column("ids").to_pylist(), counts.tolist()):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4")).cast("B")
                for p in range(at, at + n):
                    crc.append(zlib.crc32(wide[4 * offset[p]:4 * (offset[p] + length[p])]))
                at += n
            own["ids_crc32"] = pa.array(crc, pa.int64())
            own["sequence_id"] = pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts))
            yield pa.RecordBatch.from_arrays([own[c] for c in schema.names], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    return sequences.mapInArrow(unpack, ", ".join(f"{c} long" for c in schema.names))


@register("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(table(spark, sf_dir, "documents")))
