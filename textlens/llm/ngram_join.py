"""N-gram Jaccard join: T-occurrence search over inverted lists (DivideSkip).

A document's set holds the hashes of its distinct word shingles; two documents
link when the Jaccard similarity of their sets reaches a threshold t.

1. Documents with equal sets form one class, found by a hash of the set;
   everything after works on classes.
2. A set of s shingles can only link with sets that share T = ceil(t * s) of
   its shingles.  DivideSkip therefore leaves the T - 1 longest inverted lists
   aside and merges only the p = s - T + 1 short ones: whoever links with the
   set is met there, if all sets order their lists alike.  The order is:
   lists of one class, then by length, then by hash.  Lengths are counted, over
   all documents, for the shingles whose hash is below SAMPLE of its range;
   the others come last, by hash.  So each class posts its shingles below that
   mark (and further ones in the rare case that these are fewer than p).
   Lists of one class need no merging, and a set with p of them is done.
3. A star for each short list gives a graph whose components hold every linked
   pair.  They are the blocks of the search.
4. The sets of a block's classes meet in one task.  There the short lists are
   merged (by a heap; long merges are counted in an array, to the same result)
   and the long ones probed by binary search for the sets met, as long as the
   required overlap is in reach; where probing takes more steps than reading
   the long lists, these are read.  Blocks above a size are split in chunks,
   and each pair of chunks meets in a task of its own, so no task holds more
   than two chunks and no pair is lost.  A task returns a spanning forest of
   the links it found, not all pairs, and passes over sets of a component that
   holds more than half of its sets: all others are searched.
5. Components of these links, by alternating stars, give each document the
   smallest id that it reaches.

Shingle hashes and class ids have 64 bits.  Null or wordless texts have empty
sets and link with nothing, not even with each other.  Repeated rows count as
one document each; a null id never names a component.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, forget, grouped, mix, register, slices, table, window_hashes, word_hashes, written
from .components import components

SHINGLE = 5
#: The similarity, in percent.
PERCENT = 80
#: The share of the range of hashes for which lengths of lists are counted;
#: more than 1 - PERCENT / 100, so that it gives most sets all their short lists.
SAMPLE = 0.3
#: Shingles of the sets that a chunk holds (8 bytes each), and its classes.
CHUNK_SHINGLES, CHUNK_CLASSES = 4_000_000, 8_000
#: Members of blocks up to which their table is broadcast (some 40 bytes each).
BROADCAST_ROWS = 500_000


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; with fewer words than
    ``size``, the whole sequence as one."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(h) < size:
        return window_hashes(h, len(h)) ^ np.uint64(len(h))
    return np.unique(window_hashes(h, size))


def need(size: int, percent: int = PERCENT) -> int:
    """How many shingles a set shares with whatever it links with, at least."""
    return -(-percent * size // 100)


def class_id(own: np.ndarray) -> int:
    """A 64-bit hash of a set (signed, as Spark's long)."""
    place = np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.add.reduce(mix(own ^ mix(place)))
    return int(mix(np.asarray([total], np.uint64)).view(np.int64)[0])


def short_count(size: int, percent: int = PERCENT) -> int:
    return size - need(size, percent) + 1


def posted(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles that a class posts: those below the mark, at least p."""
    below = int(np.searchsorted(own, np.uint64(SAMPLE * 2 ** 64)))
    return own[:max(below, short_count(len(own), percent))]


def linked(overlap, a, b, percent: int = PERCENT):
    return 100 * overlap >= percent * (a + b - overlap)


def merged_counts(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets on some inverted lists, and on how many each: by a heap for
    short lists, by counting into an array where that takes fewer steps."""
    if sum(map(len, lists)) > max(64, n // 8):
        counts = np.bincount(np.concatenate(lists), minlength=n)
        found = np.flatnonzero(counts)
        return found, counts[found]
    sets, counts = [], []
    for y in heapq.merge(*[x.tolist() for x in lists]):
        if sets and sets[-1] == y:
            counts[-1] += 1
        else:
            sets.append(y)
            counts.append(1)
    return np.asarray(sets, np.int64), np.asarray(counts, np.int64)


def search(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of all links between the given sets."""
    n = len(sets)
    sizes = np.asarray([len(s) for s in sets], np.int64)
    values, every = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # inverted lists, each sorted by set: those of value v are posting[bounds[v]:bounds[v + 1]]
    order = np.argsort(every, kind="stable")
    posting = np.repeat(np.arange(n), sizes)[order]
    length = np.bincount(every, minlength=len(values))
    bounds = np.concatenate([[0], np.cumsum(length)])
    codes = every[order] * n + posting
    group = np.arange(n)  # the component of each set
    members = np.ones(n, np.int64)
    edges = []
    for x in range(n):
        if 2 * members[group[x]] > n:
            continue  # links between two sets of such a component add nothing, and all others are searched
        mine = every[starts[x]:starts[x] + sizes[x]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        t = need(len(mine), percent)
        short, long = mine[:len(mine) - t + 1], mine[len(mine) - t + 1:]
        short = short[length[short] > 1]
        if not len(short):
            continue
        met, count = merged_counts([posting[bounds[v]:bounds[v + 1]] for v in short.tolist()], n)
        required = -(-percent * (sizes[x] + sizes[met]) // (100 + percent))
        open_ = (group[met] != group[x]) & (count + len(long) >= required)
        met, count = met[open_], count[open_]
        if not len(met):
            continue
        if 8 * len(met) * len(long) <= length[long].sum():  # is the set on each long list?
            probe = (long[None, :] * n + met[:, None]).ravel()
            at = np.minimum(np.searchsorted(codes, probe), len(codes) - 1)
            count = count + (codes[at] == probe).reshape(len(met), len(long)).sum(1)
        else:
            both = np.bincount(np.concatenate([posting[bounds[v]:bounds[v + 1]] for v in long.tolist()]), minlength=n)
            count = count + both[met]
        for y in met[linked(count, sizes[x], sizes[met], percent)].tolist():
            if group[y] != group[x]:
                edges.append((x, y))
                small, large = sorted((group[x], group[y]), key=lambda g: members[g])
                members[large] += members[small]
                group[group == small] = large
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs`` (columns
    ``id_col`` and ``text``): the size of its set, and the smallest id that it
    reaches by links."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def describe(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                n, node, below = [], [], []
                for text in as_bytes(batch.column("text")):
                    own = shingles(text, size)
                    n.append(len(own))
                    node.append(class_id(own) if len(own) else None)
                    below.append(int(np.searchsorted(own, np.uint64(SAMPLE * 2 ** 64))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, node, below))], names=["doc_id", "n", "node", "below"])

    def post(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = {}
                for text in as_bytes(batch.column("text")):
                    own = shingles(text, size)
                    if len(own):
                        found[class_id(own)] = posted(own, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.fromiter(found, np.int64, len(found)), [len(x) for x in found.values()])),
                     pa.array(np.concatenate([np.zeros(0, np.uint64), *found.values()]).view(np.int64))], names=["node", "key"])

    described = written(rows.mapInArrow(describe, f"doc_id {kind}, n long, node long, below long"), "described")
    # one document stands for each class
    classes = (described.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
               .groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("below").alias("below")))
    postings = rows.select("text").mapInArrow(post, "node long, key long").repartition("key")
    lists = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("length")).where("low <> high")
    counted = (F.col("key") >= 0) & (F.col("key") < int(SAMPLE * 2 ** 64))  # the others count as longest
    shared = written(postings.join(lists, "key").select("node", "key", F.when(counted, F.col("length")).alias("length"))
                     .repartition("node").distinct(), "shared")
    per_node = Window.partitionBy("node")
    ranked = (shared.withColumn("turn", F.row_number().over(per_node.orderBy(F.col("length").asc_nulls_last(), "key")))
              .withColumn("counted", F.count("length").over(per_node)))
    alone = F.col("below") - F.col("counted")  # lists of one class
    short = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    merged = (ranked.join(classes.select("node", "n", "below"), "node")
              .where(F.col("length").isNull() | (F.col("turn") <= short - alone)).select("node", "key"))
    ends = merged.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    stars = merged.join(ends, "key").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    blocks = components(stars, "blocks").select("node", F.col("root").alias("block"))
    forget(shared)
    # large blocks are cut in chunks
    members = blocks.join(classes, "node")
    sized = members.groupBy("block").agg(F.greatest(F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)),
                                                    F.ceil(F.count("*") / F.lit(CHUNK_CLASSES))).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = written(members.join(sized, "block").select("node", "first", "block", "chunks", own.alias("chunk")), "members")

    def sets(batches):
        schema = pa.schema([("task", pa.string()), ("node", pa.int64()), ("own", pa.binary())])
        for whole in batches:
            for batch in slices(whole, "text"):
                out: dict[str, list] = {"task": [], "node": [], "own": []}
                for text, node, block, chunks, chunk in zip(as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("node", "block", "chunks", "chunk"))):
                    found = shingles(text, size)
                    if not len(found) or class_id(found) != node:
                        continue
                    for other in [i for i in range(chunks) if i != chunk] or [chunk]:
                        out["task"].append(f"{block}/{min(chunk, other)}/{max(chunk, other)}")
                        out["node"].append(node)
                        out["own"].append(found.tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    def find(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for _, part in grouped(batches, "task"):
            by = dict(zip(part.column("node").to_pylist(), part.column("own").to_pylist()))
            nodes = sorted(by)
            edges = search([np.frombuffer(by[x], np.uint64) for x in nodes], percent)
            yield pa.RecordBatch.from_pydict({"u": [nodes[a] for a, _ in edges], "v": [nodes[b] for _, b in edges]}, schema=schema)

    few = placed.count() <= BROADCAST_ROWS
    edges = (rows.join(F.broadcast(placed) if few else placed, F.col("doc_id") == F.col("first")).select("text", "node", "block", "chunks", "chunk")
             .mapInArrow(sets, "task string, node long, own binary")
             .repartition("task").sortWithinPartitions("task", "node").mapInArrow(find, "u long, v long"))
    roots = components(edges, "links")
    named = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = named.join(least, "root").select(F.col("node").alias("_node"), "component_id")
    return (described.join(answer, F.col("node") == F.col("_node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


@register("op7_ngram_join", """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, u AS h FROM sets, unnest(s) AS t(u)),
often AS (SELECT h FROM items GROUP BY h HAVING count(*) > 1),
shared AS (SELECT * FROM items WHERE h IN (SELECT h FROM often)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
  SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.b, s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id
""")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
