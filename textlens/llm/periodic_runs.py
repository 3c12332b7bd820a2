"""Periodic runs of words: maximal repetitions by longest common extensions over
a difference cover.

A run is a stretch of consecutive words with smallest period q and at least
max(LEAST, 3 q) words that no neighbouring word extends keeping the period.

1. *Grid.*  A run of period q holds M = max(LEAST - q, 2 q) consecutive places
   i with word i equal to word i + q, so it holds a whole window of PROBE such
   places that starts on the grid of multiples of M - PROBE + 1.  For each q
   the grid is stepped through; the steps of all q add up to a harmonic sum, n
   log n places.  A place whose PROBE-word window has the hash of the window q
   words on is a candidate (equal windows always have equal hashes).
2. *Extension.*  A candidate (i, i + q) is extended exactly, on word numbers,
   forwards and backwards (the reversed text), by longest common extensions.
   Only suffixes at places of a difference cover modulo COVER_MOD are sorted:
   for any two places fewer than COVER_MOD words on both are in the cover.  So
   a query compares those few words, takes the least common prefix of the two
   sampled suffixes from a sparse table over their sorted order (in blocks of
   COVER_MOD words) and compares the few words of the block that differs.
3. *Smallest periods.*  A stretch found with several periods has at least three
   times each of them in words, so the smallest divides the others and has
   itself met the length that a run needs: it is kept.

A text without a repeated window of PROBE words has no run and is passed over
before the structures are built.  Every text is searched whole, in one task
slice; the arrays of a text take some hundred bytes a word, whatever it holds.

Null and empty texts have no words and no runs; equal texts give equal results;
a repeated id gives a row each time; a null id stays null; an empty table gives
no rows.  Of the input's columns only the id and the text are read, so columns
of any other name may be there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, register, slices, table, window_hashes, word_hashes

#: Words that a run has at least.
LEAST = 24
#: Words compared by hash at a place of the grid; a run has 2 * PROBE - 1 of them for any period.
PROBE = 8
#: A perfect difference set: every residue is a difference of two members.
COVER_MOD, COVER = 13, (0, 1, 3, 9)
#: Places of the grid that are looked at in one go.
GRID = 1 << 19


def _meeting() -> np.ndarray:
    """meeting[a, b]: the least d with a + d and b + d both in the cover."""
    inside = np.isin(np.arange(COVER_MOD), COVER)
    place = np.arange(COVER_MOD)
    both = inside[(place[:, None, None] + place) % COVER_MOD] & inside[(place[None, :, None] + place) % COVER_MOD]
    return both.argmax(axis=2)


MEETING = _meeting()


class CommonExtensions:
    """Longest common extensions of a sequence of word numbers (0 and up)."""

    def __init__(self, words: np.ndarray):
        n, v = len(words), COVER_MOD
        self.n = n
        self.words = np.concatenate([words, np.full(2 * v, -1, words.dtype)])
        place = np.arange(n)
        spots = place[np.isin(place % v, COVER)]  # ascending: the spot v words on is len(COVER) further
        self.at = np.full(n + v, -1, np.int64)
        self.at[spots] = np.arange(len(spots))
        blocks = np.ascontiguousarray(self.words[spots[:, None] + np.arange(v)])
        names = np.unique(blocks.view(np.dtype((np.void, v * blocks.itemsize))).ravel(), return_inverse=True)[1].reshape(-1)
        # Doubling over blocks: after level j names order the first 2^j blocks.
        levels, step, m = [names.astype(np.int64)], len(COVER), len(spots)
        while step < m and levels[-1].max(initial=0) < m - 1:
            ahead = np.zeros(m, np.int64)
            ahead[:m - step] = levels[-1][step:] + 1
            levels.append(np.unique(levels[-1] * (m + 1) + ahead, return_inverse=True)[1].reshape(-1))
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        self.table = [self._shared(levels, order[:-1].copy(), order[1:].copy(), m)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _shared(levels, a, b, m):
        """The common blocks of the sampled suffixes a and b (a and b change)."""
        shared = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
            shared[same] += 1 << level
            a[same] += len(COVER) << level
            b[same] += len(COVER) << level
        return shared

    def _step(self, i, j, most):
        """How many of the next ``most`` words agree (``most`` at most 2 * COVER_MOD)."""
        found, going = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(int(most.max(initial=0))):
            going = going[most[going] > t]
            a, b = self.words[i[going] + t], self.words[j[going] + t]
            going = going[(a == b) & (a >= 0)]
            found[going] += 1
        return found

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal words from i and from j > i on, for each pair."""
        meet = MEETING[i % COVER_MOD, j % COVER_MOD]
        total = self._step(i, j, meet)
        left = np.flatnonzero((total == meet) & (j + meet < self.n))
        if not len(left):
            return total
        a, b = i[left] + meet[left], j[left] + meet[left]
        ra, rb = self.rank[self.at[a]], self.rank[self.at[b]]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp(hi - lo)[1] - 1
        blocks = np.empty(len(left), np.int64)
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            blocks[here] = np.minimum(self.table[k][lo[here]], self.table[k][hi[here] - (1 << k)])
        a, b = a + COVER_MOD * blocks, b + COVER_MOD * blocks
        total[left] += COVER_MOD * blocks + self._step(np.minimum(a, self.n), np.minimum(b, self.n), np.full(len(left), COVER_MOD))
        return total


def _grid(hashes: np.ndarray, n: int):
    """Blocks of candidates (place, period), smallest periods first."""
    last = n // 3
    periods = np.arange(1, last + 1)
    steps = np.maximum(LEAST - periods, 2 * periods) - PROBE + 1
    counts = np.maximum(0, n - PROBE - periods) // steps + 1
    ends = np.cumsum(counts)
    first = 0
    while first < last:
        until = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GRID, "right")))
        q, c, s = periods[first:until], counts[first:until], steps[first:until]
        begin = np.repeat(np.cumsum(c) - c, c)
        place = (np.arange(int(c.sum())) - begin) * np.repeat(s, c)
        period = np.repeat(q, c)
        same = hashes[place] == hashes[place + period]
        yield place[same], period[same]
        first = until


def find_runs(words: list[bytes]) -> np.ndarray:
    """The runs of a text: rows (start, length, period) by start, then period."""
    none = np.zeros((0, 3), np.int64)
    n = len(words)
    if n < LEAST:
        return none
    hashes = window_hashes(word_hashes(words), PROBE)
    if len(np.unique(hashes)) == len(hashes):
        return none
    ends = None
    found = []
    for place, period in _grid(hashes, n):
        if not len(place):
            continue
        if ends is None:
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, n)
            ends = CommonExtensions(ids), CommonExtensions(ids[::-1])
        after = ends[0].extend(place, place + period)
        # In the reversed text the word before place + period comes first.
        back = np.zeros(len(place), np.int64)
        some = np.flatnonzero(place > 0)
        back[some] = ends[1].extend(n - place[some] - period[some], n - place[some])
        start, length = place - back, after + back + period
        good = length >= np.maximum(LEAST, 3 * period)
        found.append(np.unique(np.stack([start[good], length[good], period[good]], axis=1), axis=0))
    if not found:
        return none
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return none
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; of equal ones the first
    start, then the smallest period."""
    if not len(runs):
        return None
    rough = runs[:, 1] / runs[:, 2]
    near = runs[rough >= rough.max() * (1 - 1e-9)].tolist()
    return min(map(tuple, near), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not len(runs):
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(marks[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: the id, ``runs`` (start, length, period) by start, then period,
    ``strongest`` (null without runs) and ``collapsed``, the kept words joined
    by one blank.  ``prepare`` may change a document's words beforehand."""
    rows = docs.select(id_col, text)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    out = pa.schema([("runs", pa.list_(run)), ("strongest", run), ("collapsed", pa.binary())])

    def search(batches):
        names = ("start", "length", "period")
        for whole in batches:
            for batch in slices(whole, text):
                found = []
                for i, value in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    words = (value or b"").split()
                    if prepare is not None:
                        words = prepare(i, words)
                    runs = find_runs(words)
                    best = strongest(runs)
                    found.append({"runs": [dict(zip(names, r)) for r in runs.tolist()],
                                  "strongest": best and dict(zip(names, best)),
                                  "collapsed": b" ".join(collapse(words, runs))})
                part = pa.RecordBatch.from_pylist(found, schema=out)
                yield pa.RecordBatch.from_arrays([batch.column(0), *part.columns], names=[id_col, *out.names])

    kind = "struct<start: long, length: long, period: long>"
    return rows.mapInArrow(search, f"`{id_col}` {dict(rows.dtypes)[id_col]}, runs array<{kind}>, strongest {kind}, collapsed binary")


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rule of the contract: of every tenth document by checksum of its id
    the words from some place on repeat with some period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=repeat_tail)

    def digest(batches):
        for batch in batches:
            runs, collapsed = batch.column("runs").to_pylist(), batch.column("collapsed").to_pylist()
            best = [b or dict.fromkeys(("start", "length", "period")) for b in batch.column("strongest").to_pylist()]
            lines = ["".join(f"{r['start']},{r['length']},{r['period']}\n" for r in one) for one in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, runs), pa.int64()),
                 *[pa.array([b[c] for b in best], pa.int64()) for c in ("start", "length", "period")],
                 pa.array([None if b["period"] is None else 1000 * b["length"] // b["period"] for b in best], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]),
                 pa.array([hashlib.sha256(x).hexdigest() for x in collapsed])],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return found.mapInArrow(digest, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                    "runs_sha256 string, collapsed_sha256 string")
