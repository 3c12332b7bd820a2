"""Ranked lexical search: a document FP-tree, searched depth first with bounds.

Every item of a query table is ranked against all documents.

1. Items are taken in blocks of at most BLOCK_BYTES of text; their distinct
   terms are the vocabulary.  One pass over the documents keeps of each its
   number of terms and its *restricted term vector*: the terms of the
   vocabulary that it holds, with their counts.  The vectors are written.
2. The number of documents, their terms in all and the document frequency of
   each term of the vocabulary are counted over all vectors.
3. Each task builds trees over the vectors it reads (TREE_TERMS vector terms at
   most in one).  A vector's terms are put in descending document frequency, so
   vectors share the paths of their frequent terms: the sorted vectors form a
   trie whose subtrees are ranges.  Chains without a branch are one edge, and a
   subtree of at most LEAF documents is a leaf.  Each node stores, for the
   terms that occur in its subtree, the worth of the largest count of the term
   there with the least m of the subtree's documents; no document below can
   gain more from this term.
4. Per item the trees are searched depth first, best bound first: a subtree
   whose bound is below the K-th best score so far is passed over (one of equal
   bound is searched, as a smaller id may be in it).  The best of one tree set
   the mark for the next tree of the task.
5. A task returns at most K documents per item; two rounds of ranks, per group
   of tasks and over all, leave the K best of each item.

The driver holds a block of items and its terms' counts; a task one tree.  The
weights and worths are those of ``weight``, ``length_factor`` and ``worth``.

Null texts and texts without a term are no documents; items without a term, or
whose terms no document holds, have no rows.  Repeated documents are ranked
each, in the order of their ids (a null id last); repeated items are ranked
each.  An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, forget, register, slices, table, written

#: Documents returned per item.
K = 10
#: Bytes of item text searched in one pass over the documents.
BLOCK_BYTES = 8 << 20
#: Vector terms in one tree.
TREE_TERMS = 1 << 20
#: A subtree of so many documents is not split further.
LEAF = 48
#: Groups of tasks whose best are ranked before all are.
GROUPS = 64

_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """m of documents of ``n`` terms (in Python's integers where 64 bits might not do)."""
    if len(n) and int(n.max()) * n_docs > (1 << 63) // 75 - 1:
        return np.asarray([25 + 75 * x * n_docs // all_terms for x in n.tolist()], np.int64)
    return 25 + (75 * n * n_docs) // max(all_terms, 1)


def worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term of weight 1 in an item adds to a score."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """A trie over restricted term vectors.

    ``starts`` bounds the vectors in ``terms`` (numbers by descending document
    frequency, ascending inside a vector) and ``tf``; ``m`` is per document."""

    def __init__(self, ids: list, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        # Lexicographic order of the vectors, of equal ones the shorter document first.
        keys = terms.astype(">u4").tobytes()
        order = sorted(range(len(ids)), key=lambda d: (keys[4 * starts[d]:4 * starts[d + 1]], m[d]))
        sizes = np.diff(starts)[order]
        take = np.repeat(starts[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.ids = [ids[d] for d in order]
        self.m = m[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.tf = terms[take], tf[take]
        self.worth = worth(self.tf, np.repeat(self.m, sizes))
        self.leaf = leaf
        #: per node: first and last document, depth of its path
        self.nodes: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.bounds: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow()

    def _grow(self) -> None:
        sizes = np.diff(self.starts)
        todo = [(0, len(self.ids), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            node = len(self.nodes)
            self.nodes.append((lo, hi))
            self.children.append([])
            self.bounds.append(self._bound(lo, hi))
            if parent >= 0:
                self.children[parent].append(node)
            while hi - lo > self.leaf:
                # The term at this depth of each path (-1: the vector ends here).
                term = np.full(hi - lo, -1, np.int64)
                long = np.flatnonzero(sizes[lo:hi] > depth)
                if not len(long):
                    break
                term[long] = self.terms[self.starts[lo:hi][long] + depth]
                cuts = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), hi - lo]
                depth += 1
                if len(cuts) > 2:
                    todo += [(lo + a, lo + b, depth, node) for a, b in self._packed(cuts)]
                    break

    def _packed(self, cuts: list[int]) -> Iterator[tuple[int, int]]:
        """Neighbouring branches that fit into one leaf together go together."""
        a = cuts[0]
        for b, after in zip(cuts[1:], [*cuts[2:], None]):
            if after is None or after - a > self.leaf:
                yield a, b
                a = b

    def _bound(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms below a node and the most that each can be worth there."""
        part = slice(self.starts[lo], self.starts[hi])
        terms, tf = self.terms[part], self.tf[part]
        order = np.argsort(terms, kind="stable")
        terms, tf = terms[order], tf[order]
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        most = np.maximum.reduceat(tf, first) if len(first) else tf
        return terms[first], worth(most, np.full(len(first), self.m[lo:hi].min(), np.int64))

    def search(self, gain: np.ndarray, best: list, k: int) -> int:
        """Put this tree's documents with a score above 0 into ``best``, a heap
        of at most ``k`` (score, reversed id), worst first.  ``gain`` is the
        item's weight of every term.  Returns the number of leaves scored."""
        scored, todo = 0, [(0, 0)]
        todo[0] = (self._most(0, gain), 0)
        while todo:
            bound, node = todo.pop()
            if bound <= 0 or len(best) == k and bound < best[0][0]:
                continue
            if not self.children[node]:
                scored += 1
                lo, hi = self.nodes[node]
                self._score(lo, hi, gain, best, k)
                continue
            below = [(self._most(c, gain), c) for c in self.children[node]]
            todo += sorted(below)
        return scored

    def _most(self, node: int, gain: np.ndarray) -> int:
        terms, most = self.bounds[node]
        return int(gain[terms] @ most)

    def _score(self, lo: int, hi: int, gain: np.ndarray, best: list, k: int) -> None:
        a, b = self.starts[lo], self.starts[hi]
        if a == b:
            return
        sums = np.concatenate([[0], np.cumsum(gain[self.terms[a:b]] * self.worth[a:b])])
        scores = sums[self.starts[lo + 1:hi + 1] - a] - sums[self.starts[lo:hi] - a]
        least = best[0][0] if len(best) == k else 1
        for d in np.flatnonzero(scores >= least).tolist():
            entry = (int(scores[d]), _Later(self.ids[lo + d]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif best[0] < entry:
                heapq.heapreplace(best, entry)


class _Later:
    """An id, ordered so that the later one (null last) is the smaller."""

    __slots__ = ("id",)

    def __init__(self, i):
        self.id = i

    def __lt__(self, other):
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other):
        return self.id == other.id


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, terms, tf): per document with a term, how many it has, the
    numbers of those in the vocabulary and their counts."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def restrict(batches):
        numbers = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, ns, ends, found, counts = [], [], [0], [], []
                for i, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                    terms = terms_of(text)
                    if not terms:
                        continue
                    held = Counter(filter(numbers.__contains__, terms))
                    ids.append(i)
                    ns.append(len(terms))
                    found += map(numbers.__getitem__, held)
                    counts += held.values()
                    ends.append(len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64()))], schema=schema)

    return rows.mapInArrow(restrict, "doc_id long, n long, terms array<int>, tf array<long>")


def blocks(items: DataFrame, item_col: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, Counter]]]:
    """The items with their terms, in blocks of at most ``limit`` bytes of text
    (or one item); the driver holds one block at a time."""
    held, size = [], 0
    for r in items.select(F.col(item_col).alias("item"), "text").toLocalIterator(prefetchPartitions=False):
        text = (r["text"] or "").encode()
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        terms = Counter(terms_of(text))
        if terms:
            held.append((r["item"], terms))
            size += len(text)
    if held:
        yield held


def _rank_block(docs: DataFrame, block: list, id_col: str, k: int) -> tuple[DataFrame, DataFrame] | None:
    """The best of each task for a block of items, and the vectors behind it."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in block))))}
    vectors = written(restricted(docs, vocabulary, id_col), "vectors")
    n_docs, all_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        forget(vectors)
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the block
        df[r["t"]] = r["count"]
    by_frequency = np.argsort(-df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[by_frequency] = np.arange(len(df))
    # Per item: the places of its terms and what they weigh, repeats included.
    asked = []
    for _, terms in block:
        at = np.asarray([vocabulary[t] for t in terms], np.int64)
        w = np.asarray([c * weight(n_docs, int(df[i])) for i, c in zip(at.tolist(), terms.values())], np.int64)
        asked.append((place[at].astype(np.int32), w))
    shared = spark.sparkContext.broadcast((place, asked))

    def trees(batches):
        ids, sizes, terms, tfs, ns, held = [], [], [], [], [], 0
        for batch in batches:
            counts = batch.column("terms").value_lengths().to_numpy()
            ends = np.cumsum(counts)
            a = 0
            while a < batch.num_rows:
                room = TREE_TERMS - held + (int(ends[a - 1]) if a else 0)
                b = max(a + 1, int(np.searchsorted(ends, room, "right")))
                part = batch.slice(a, b - a)
                ids += part.column("doc_id").to_pylist()
                sizes.append(counts[a:b])
                terms.append(part.column("terms").flatten().to_numpy())
                tfs.append(part.column("tf").flatten().to_numpy())
                ns.append(part.column("n").to_numpy())
                held += int(counts[a:b].sum())
                a = b
                if held >= TREE_TERMS or a < batch.num_rows:
                    yield ids, sizes, terms, tfs, ns
                    ids, sizes, terms, tfs, ns, held = [], [], [], [], [], 0
        if ids:
            yield ids, sizes, terms, tfs, ns

    def search(batches):
        place, asked = shared.value
        gain = np.zeros(len(place), np.int64)
        best: list[list] = [[] for _ in asked]
        for ids, sizes, terms, tfs, ns in trees(batches):
            size = np.concatenate(sizes).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(size)])
            term, tf = place[np.concatenate(terms)], np.concatenate(tfs)
            order = np.lexsort((term, np.repeat(np.arange(len(size)), size)))
            tree = Tree(ids, starts, term[order], tf[order], length_factor(np.concatenate(ns), n_docs, all_terms))
            for heap, (at, w) in zip(best, asked):
                gain[at] = w
                tree.search(gain, heap, k)
                gain[at] = 0
        rows = [(j, e[1].id, e[0]) for j, heap in enumerate(best) for e in heap]
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64()), pa.array([group] * len(rows), pa.int32())],
                                         names=["item", "doc_id", "score", "grp"])

    found = vectors.where(F.size("terms") > 0).mapInArrow(search, "item int, doc_id long, score long, grp int")
    return found, vectors


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", item_col: str = "item_id",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_col]
    done = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in blocks(items, item_col, block_bytes):
        got = _rank_block(docs, block, id_col, k)
        if got is None:
            continue
        found, vectors = got
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for part in (["item", "grp"], ["item"]):
            found = (found.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
                     .where(F.col("rank") <= k))
        names = spark.createDataFrame(list(enumerate(i for i, _ in block)), f"item int, item_id {kind}")
        best = written(found.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        forget(vectors)
        done = done.unionByName(best)
    return done


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
     held AS (SELECT doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
     totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM held),
     asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
     tfs AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held)
             WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
     ws AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tfs, totals GROUP BY term),
     scores AS (SELECT item_id, doc_id,
                       sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
                FROM asked JOIN tfs USING (term) JOIN ws USING (term), totals GROUP BY item_id, doc_id),
     best AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
              FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {K}
"""


@register("op11_ranked_search", SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
