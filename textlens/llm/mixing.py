"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...
and share the words of all documents; a source stops at ``MOST`` times its own
words, and what is left over is shared again by weight until none is above.

Draws: a source's documents are dealt into blocks by a hash.  Its target is
met by whole passes over its blocks and, for the rest, by blocks in a permuted
order; the last one is drawn in part, document by document in permuted order,
taking those that still fit.  So a document is taken MOST times at most, and
whole each time.

Shards: the block draws of all sources are split among the output shards by a
binary tree.  A node hands its left half as many draws as that half has room
for, taken from its sources by a multivariate hypergeometric draw; a leaf's
vector is its shard's exact quota per source.  A shard takes the next draws of
each source's permuted order, so draws are disjoint, and orders its documents
by a hash.  All random choices come from a seed: reruns agree.

There are at most ``BLOCKS`` blocks and one for each source.  Sources, blocks and
draws reach the driver (a row each); rows meet their source and their draws in
joins, which are broadcast only while there are no more sources than blocks.
Output shards are as many as the words ask for.  Null texts
have size 0; equal rows (same id and text) are drawn together, so their sizes
add up; a source without words has target 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free_name, register, table, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCKS = 16_384
BLOCK_WORDS = 50_000
#: Output shards: LEAST_SHARDS, or more where one would hold over SHARD_WORDS.
LEAST_SHARDS, SHARD_WORDS = 32, 20_000_000
SEED = 20_240_607


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_of(doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col("text"), F.lit(SEED))


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """The words to take of each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    target: dict[str | None, Fraction] = {}
    rest = Fraction(sum(sizes.values()))
    free = list(order)
    while free:
        share = rest / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        for s in full:
            target[s] = Fraction(most * sizes[s])
            rest -= target[s]
        free = [s for s in free if s not in target]
    return {s: float(target[s]) for s in order}


def split_tree(quota: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """Split the draws ``quota`` (per source) among shards with the given room
    (draws each, in all as many as the quota): a row per shard."""
    out = np.zeros((len(room), len(quota)), np.int64)

    def go(first: int, last: int, q: np.ndarray) -> None:
        if last - first == 1:
            out[first] = q
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(q, int(room[first:middle].sum()), method="marginals")
        go(first, middle, left)
        go(middle, last, q - left)

    go(0, len(room), np.asarray(quota, np.int64))
    return out


@dataclass
class Mix:
    """What to draw: block draws, and the units taken of partly drawn blocks."""

    units: DataFrame  # source, unit, doc_id, size, s, block
    sources: DataFrame  # source, s (its place), source_size, target, blocks
    shards: int
    draws: DataFrame  # s, block, pass, shard, part
    chosen: DataFrame  # s, unit: what is taken of the blocks drawn in part
    few: bool  # no more sources than blocks: the draws may be broadcast

    def sent(self, draws: DataFrame) -> DataFrame:
        return F.broadcast(draws) if self.few else draws


def _with_source(rows: DataFrame, sources: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows joined to their source's row, whose columns take ``names``; Spark
    broadcasts the table of sources by its size or shuffles."""
    key = free_name(rows, "_source")
    return (rows.join(sources.select(F.col("source").alias(key), *[F.col(c).alias(n) for c, n in names.items()]),
                      F.col("source").eqNullSafe(F.col(key))).drop(key))


def _block(s: Column, unit: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(unit, s), blocks).cast("int")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", shards: int | None = None, seed: int = SEED) -> Mix:
    """``shards``: output shards; none: by the words of all documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", unit_of(id_col).alias("unit"), size_of(F.col("text")).alias("size"))
    rows = written(rows, "sizes")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = source_targets(sizes)
    order = list(targets)
    shards = shards or max(LEAST_SHARDS, -(-sum(sizes.values()) // SHARD_WORDS))
    block_words = max(BLOCK_WORDS, sum(sizes.values()) / BLOCKS)
    sources = spark.createDataFrame([(s, i, sizes[s], targets[s], max(1, int(sizes[s] // block_words))) for i, s in enumerate(order)],
                                    "source string, s int, source_size long, target double, blocks int")
    placed = _with_source(rows, sources, {"s": "s", "blocks": "blocks"}).withColumn("block", _block(F.col("s"), F.col("unit"), F.col("blocks")))
    placed = placed.drop("blocks")
    words = placed.groupBy("s", "block").agg(F.sum("size").alias("n")).collect()
    of: dict[int, dict[int, int]] = {i: {} for i in range(len(order))}
    for r in words:
        of[r["s"]][r["block"]] = r["n"]
    drawn: list[list[tuple[int, int, int | None]]] = []  # per source: (block, pass, words of it or None for all)
    for i, s in enumerate(order):
        left, out = round(targets[s]), []
        for p in range(MOST):
            turn = np.random.default_rng([seed, 7, i, p]).permutation(sorted(of[i])).tolist()
            for b in turn:
                n = of[i][b]
                if n == 0 or left <= 0:
                    continue
                out.append((b, p, None if n <= left else left))
                left -= min(n, left)
        drawn.append(out)
    quota = np.asarray([len(x) for x in drawn], np.int64)
    total = int(quota.sum())
    room = np.asarray([total // shards + (k < total % shards) for k in range(shards)], np.int64)
    upto = np.cumsum(split_tree(quota, room, seed), axis=0) if len(order) else np.zeros((shards, 0), np.int64)
    table_rows = [(i, b, p, int(np.searchsorted(upto[:, i], j, side="right")), part)
                  for i, out in enumerate(drawn) for j, (b, p, part) in enumerate(out)]
    draws = spark.createDataFrame(table_rows, "s int, block int, pass int, shard int, part long")

    def fit(keys, found):
        """Of one block, the units that fit in its part, in permuted order."""
        import pyarrow as pa
        left = found.column("part")[0].as_py()
        size = found.column("size").to_numpy()
        unit = found.column("unit").to_numpy()
        take = []
        for k in np.argsort(found.column("turn").to_numpy(), kind="stable").tolist():
            if 0 < size[k] <= left:
                take.append(k)
                left -= int(size[k])
        rest = np.setdiff1d(np.flatnonzero(size > 0), take)
        if len(rest):
            k = rest[np.argmin(size[rest])]
            if size[k] < 2 * left:  # one more comes nearer
                take.append(int(k))
        return pa.table({"s": found.column("s").take(pa.array(take, pa.int64())), "unit": pa.array(unit[np.asarray(take, np.int64)], pa.int64())})

    few = len(order) <= BLOCKS
    partly = draws.where(F.col("part").isNotNull()).select("s", "block", "part")
    chosen = (placed.where("size > 0").join(F.broadcast(partly) if few else partly, ["s", "block"])  # rows without words are never taken
              .groupBy("s", "block", "part", "unit").agg(F.sum("size").alias("size"))
              .withColumn("turn", F.xxhash64("unit", F.lit(seed + 1)))
              .groupBy("s", "block").applyInArrow(fit, "s int, unit long"))
    return Mix(placed, sources, shards, draws, written(chosen, "chosen"), few)


def taken(mix: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row."""
    whole = mix.draws.where(F.col("part").isNull()).groupBy("s", "block").agg(F.count("*").alias("times"))
    found = mix.units.join(mix.sent(whole), ["s", "block"], "left")
    found = found.join(mix.chosen.select(F.col("s"), F.col("unit"), F.lit(1).alias("once")), ["s", "unit"], "left")
    found = found.join(mix.sources.select("s", "source_size", "target"), "s")
    return found.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.coalesce("times", F.lit(0)) + F.coalesce("once", F.lit(0)))).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: the rows of ``docs``, each as often as it is drawn, dealt to
    the output shards (one partition each) and shuffled inside of them."""
    mix = plan_mix(docs, id_col, shards, seed)
    names = {c: free_name(docs, f"_{c}") for c in ("s", "unit", "block", "draw", "blocks")}
    s, unit, block, draw, blocks = (names[c] for c in ("s", "unit", "block", "draw", "blocks"))
    rows = _with_source(docs, mix.sources, {"s": s, "blocks": blocks}).withColumn(unit, unit_of(id_col))
    rows = rows.withColumn(block, _block(F.col(s), F.col(unit), F.col(blocks)))
    plan = mix.draws.select(F.col("s").alias(s), F.col("block").alias(block), F.struct("pass", "shard", "part").alias(draw))
    rows = rows.join(mix.sent(plan), [s, block])
    whole = rows.where(F.col(f"{draw}.part").isNull())
    part = rows.where(F.col(f"{draw}.part").isNotNull()).join(mix.chosen.select(F.col("s").alias(s), F.col("unit").alias(unit)), [s, unit], "left_semi")
    every = whole.unionByName(part)
    return (every.repartitionById(mix.shards, F.col(f"{draw}.shard"))
            .sortWithinPartitions(F.xxhash64(F.col(unit), F.col(f"{draw}.pass"), F.lit(seed)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


@register("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken(plan_mix(docs))
