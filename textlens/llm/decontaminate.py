"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared without case and punctuation: A-Z is
lower-cased, each run of other ASCII characters than letters and digits is one
blank.  An item of m bytes may lie in a text with k = min(m * EDIT_SHARE,
(m - q) / q) edits (rounded down).  By the q-gram lemma such a place shares at
least m - q + 1 - k * q q-grams with the item, on diagonals that are at most k
apart.  So the shared q-grams are counted in diagonal bands of 2 * (k + 1)
that overlap by half, bands below that count go, and what is left is verified
by a banded alignment that gives the edits and the place.  Items shorter than
q must lie in the text unchanged, as whole words.

Of items of more than ``LONG`` words, parts count too: windows of ``WINDOW``
words, one each ``STEP`` words and one at the end, are searched like items with
bounds of their own.  So any WINDOW + STEP - 1 words in a row of a long item
are found.  Windows that overlap in a text are one place, whose edits are the
most of one of its windows; inside a place of the whole item they do not count.

The benchmark is cut in blocks of at most ``BLOCK_BYTES`` of text; each block
is indexed once and sent to the tasks, and every text is held against every
block.  Null and empty texts hold nothing; null or empty items match nothing.
Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, register, slices, table

Q = 12
EDIT_SHARE = 0.06
BLOCK_BYTES = 8 << 20
FILTER_BITS = 21
LONG, WINDOW, STEP = 50, 40, 10
#: In a word longer than this, each ``WORD_BYTES`` bytes count as one (scripts
#: without blanks).
LONGEST_WORD, WORD_BYTES = 32, 6

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (97, 123)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def folded(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The folded text, and each of its bytes' place in ``text``."""
    c = _FOLD[np.frombuffer(text, np.uint8)]
    blank = c == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # of a run of blanks the first stays
    at = np.flatnonzero(keep)
    return c[at], at


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 12 bytes from each place on."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    two = c[:-1].astype(np.uint16) | (c[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    eight = four[:-8].astype(np.uint64) | (four[4:-4].astype(np.uint64) << np.uint64(32))
    return (eight * np.uint64(0x9E3779B97F4A7C15) + four[8:]) * np.uint64(0xD6E8FEB86659FD93)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - FILTER_BITS)).astype(np.int32)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best place of ``item`` in ``text`` on the diagonals low..high (place
    in the text minus place in the item), free at the text's ends: (edits,
    start, end), or None if that takes more than ``budget`` edits."""
    m, width = len(item), high - low + 1
    far = m + width + 1
    lane = np.arange(width)
    places = low + lane  # of row 0: start anywhere
    cost = np.where((places >= 0) & (places <= len(text)), 0, far)
    start = places.copy()
    padded = np.concatenate([np.zeros(width + m, np.uint8), text, np.zeros(width + m, np.uint8)])
    for i in range(1, m + 1):
        at = i + low + lane  # text places after this row
        inside = (at >= 0) & (at <= len(text))
        other = padded[at - 1 + width + m] != item[i - 1]
        step = cost + np.where((at >= 1) & inside, other, far)  # the same diagonal
        drop = np.append(cost[1:] + 1, far)  # item byte without a text byte
        take = drop < step
        now = np.where(take, drop, step)
        begin = np.where(take, np.append(start[1:], 0), start)
        slide = now - lane  # text bytes without an item byte
        least = np.minimum.accumulate(slide)
        source = np.maximum.accumulate(np.where(slide == least, lane, 0))
        cost = np.where(inside, least + lane, far)
        start = begin[source]
        if cost.min() > budget:
            return None
    j = int(cost.argmin())
    if cost[j] > budget:
        return None
    return int(cost[j]), int(start[j]), m + low + j


def windows(c: np.ndarray) -> list[np.ndarray]:
    """The different windows of a long item; none of others."""
    blank = np.flatnonzero(c == 32)
    first, last = np.append(0, blank + 1), np.append(blank, len(c))
    if (last - first).max() > LONGEST_WORD:
        cuts = [(p, min(p + WORD_BYTES, z) if z - a > LONGEST_WORD else z) for a, z in zip(first.tolist(), last.tolist())
                for p in (range(a, z, WORD_BYTES) if z - a > LONGEST_WORD else (a,))]
        first, last = np.asarray(cuts).T
    n = len(first)
    if n <= LONG:
        return []
    found = {}
    for k in [*range(0, n - WINDOW, STEP), n - WINDOW]:
        a, z = int(first[k]), int(last[k + WINDOW - 1])
        while a > 0 and c[a] & 0xC0 == 0x80:  # no cut inside of a letter
            a -= 1
        while z < len(c) and c[z] & 0xC0 == 0x80:
            z += 1
        found.setdefault(c[a:z].tobytes(), c[a:z])
    return list(found.values())


class Index:
    """The q-grams of a block of items."""

    def __init__(self, ids: list[int], texts: list[bytes], edit_share: float = EDIT_SHARE):
        self.ids, self.items, self.words = [], [], []
        for i, text in zip(ids, texts):
            c, _ = folded(text or b"")
            c = c[int(len(c) > 0 and c[0] == 32):]
            c = c[:len(c) - int(len(c) > 0 and c[-1] == 32)]
            if not len(c):
                continue
            if len(c) < Q:
                self.words.append((i, b" " + c.tobytes() + b" "))
            else:
                self.ids.append(i)
                self.items.append(c)
        self.whole = list(range(len(self.items)))  # the item that an item is, or is a window of
        for k in range(len(self.items)):
            for c in windows(self.items[k]):
                self.ids.append(self.ids[k])
                self.items.append(c)
                self.whole.append(k)
        size = np.asarray([len(c) for c in self.items], np.int64)
        self.budget = np.minimum((size * edit_share).astype(np.int64), (size - Q) // Q)
        self.least = size - Q + 1 - self.budget * Q
        self.size = size
        every = [grams(c) for c in self.items]
        flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(every)), [len(g) for g in every])
        place = np.concatenate([np.arange(len(g)) for g in every]) if every else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[_slot(self.keys)] = True
        self.fewest = int(self.least.min()) if len(size) else 0
        self.longest = int((size + self.budget).max()) if len(size) else 0

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of each place, in bytes of ``text``."""
        if not text:
            return []
        c, at = folded(text)
        out = []
        if self.words:
            line = b" " + c.tobytes() + b" "
            for i, w in self.words:
                j = line.find(w)
                while j >= 0:
                    out.append((i, int(at[j]), int(at[j + len(w) - 3]) + 1, 0))
                    j = line.find(w, j + 1)
        if not len(self.keys):
            return out
        g = grams(c)
        spots = np.flatnonzero(self.filter[_slot(g)])
        near = self.fewest - 1
        if len(spots) <= near:
            return out
        dense = np.flatnonzero(spots[near:] - spots[:len(spots) - near] <= self.longest)
        if not len(dense):
            return out
        cover = np.zeros(len(spots) + 1, np.int64)  # only hits that lie dense enough for any item
        np.add.at(cover, dense, 1)
        np.add.at(cover, dense + near + 1, -1)
        spots = spots[np.cumsum(cover[:-1]) > 0]
        key = np.searchsorted(self.keys, g[spots])
        key = np.minimum(key, len(self.keys) - 1)
        good = self.keys[key] == g[spots]
        spots, key = spots[good], key[good]
        if not len(spots):
            return out
        times = self.times[key]
        begin = np.repeat(self.first[key] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, place = self.item[begin], self.place[begin]
        diagonal = np.repeat(spots, times) - place + self.size[item]  # never negative
        step = self.budget[item] + 1
        cell = diagonal // step
        wide = np.int64(len(c) + self.longest + 2)
        code = item * wide + cell  # band b holds the cells b - 1 and b
        order = np.argsort(np.concatenate([code, code + 1]), kind="stable")
        code = np.concatenate([code, code + 1])[order]
        cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        places: dict[int, list[tuple[int, int, int]]] = {}
        for at_cut in np.flatnonzero(np.diff(cuts) >= self.least[code[cuts[:-1]] // wide]).tolist():
            mine = order[cuts[at_cut]:cuts[at_cut + 1]] % len(place)
            i, b = divmod(int(code[cuts[at_cut]]), int(wide))
            if len(set(place[mine].tolist())) < self.least[i]:  # an item's gram counts once in a band
                continue
            k, m = int(self.budget[i]), int(self.size[i])
            lanes, votes = np.unique(diagonal[mine], return_counts=True)
            d = int(lanes[votes.argmax()]) - m
            if d >= 0 and np.array_equal(c[d:d + m], self.items[i]):
                places.setdefault(i, []).append((0, d, d + m))
                continue
            # a place lies within k of the diagonals that its grams are on
            low, high = (b - 1) * (k + 1) - m - k, (b + 1) * (k + 1) - 1 - m + k
            a, z = max(0, low), min(len(c), high + m)
            got = align(self.items[i], c[a:z], low - a, high - a, k)
            if got:
                places.setdefault(i, []).append((got[0], got[1] + a, got[2] + a))
        of: dict[int, list[tuple[int, int]]] = {}  # places of whole items
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for i, all_of in sorted(places.items()):  # whole items come first
            taken: list[tuple[int, int]] = []
            for edits, s, e in sorted(set(all_of)):
                if not all(e <= x or s >= y for x, y in taken):
                    continue
                taken.append((s, e))
                if self.whole[i] == i:
                    out.append((self.ids[i], int(at[s]), int(at[e - 1]) + 1, edits))
                elif all(e <= x or s >= y for x, y in of.get(self.whole[i], [])):
                    parts.setdefault(self.whole[i], []).append((s, e, edits))
            if self.whole[i] == i:
                of[i] = taken
        for i, pieces in parts.items():
            united: list[list[int]] = []
            for s, e, edits in sorted(pieces):
                if united and s < united[-1][1]:
                    united[-1][1:] = max(e, united[-1][1]), max(edits, united[-1][2])
                else:
                    united.append([s, e, edits])
            out += [(self.ids[i], int(at[s]), int(at[e - 1]) + 1, edits) for s, e, edits in united]
        return sorted(out)


def indexes(benchmark: DataFrame, id_col: str = "item_id", edit_share: float = EDIT_SHARE):
    """The benchmark's blocks, one by one, as broadcast indexes; each block's
    text, with the windows of long items, is at most about ``BLOCK_BYTES``."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col("text").alias("t"))
    bytes_of = F.octet_length("t").cast("long")
    size = rows.agg(F.sum(F.when(bytes_of > 2 * LONG, bytes_of * (1 + WINDOW // STEP)).otherwise(bytes_of) + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // (BLOCK_BYTES // 2)))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toArrow().sort_by([("i", "ascending"), ("t", "ascending")])
        yield spark.sparkContext.broadcast(Index(part.column("i").to_pylist(), [x.encode() for x in part.column("t").to_pylist()], edit_share))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, item_id, start, end, edits) of each place where a text holds a
    benchmark item; start and end in code points, end exclusive."""
    rows = docs.select(F.col(id_col).alias("doc_id"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    answer = None
    for shared in indexes(benchmark):

        def find(batches, shared=shared):
            index = shared.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    out, row = {"item_id": [], "start": [], "end": [], "edits": []}, []
                    for r, text in enumerate(as_bytes(batch.column("text"))):
                        for i, s, e, edits in index.find(text or b""):
                            row.append(r)
                            start = len(text[:s].decode("utf-8", "replace"))
                            for k, v in zip(out, (i, start, start + len(text[s:e].decode("utf-8", "replace")), edits)):
                                out[k].append(v)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(v, pa.int64()) for v in out.values())],
                        names=["doc_id", *out])

        part = rows.mapInArrow(find, f"doc_id {kind}, item_id long, start long, end long, edits long")
        answer = part if answer is None else answer.unionByName(part)
    return answer


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (column ``text``) that hold no benchmark item."""
    for shared in indexes(benchmark):

        def clean(batches, shared=shared):
            index = shared.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    yield batch.filter(pa.array([not index.find(x or b"") for x in as_bytes(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


@register("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: a row for each place of a benchmark item."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
