"""Connected components of an edge table, by alternating stars.

Each round lets every node hand its smallest neighbour to its larger
neighbours (large star), then every node hand its smallest smaller neighbour
to the other smaller ones (small star).  The edges shrink to one star per
component in a logarithmic number of rounds.  Each round is written to the
shared folder; nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, name: str) -> DataFrame:
    """``edges``: (u long, v long).  Returns (node, root): the smallest node of
    its component, for every node that has an edge to another node."""
    e = written(edges.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), name)
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("s")).first()
        if tuple(now) == state or now["n"] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        state = tuple(now)
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").where("m <> v")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(down, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .unionByName(down.select(F.col("m").alias("lo"), "hi"))).distinct()
        old, e = e, written(small, name)
        forget(old)
