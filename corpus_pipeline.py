"""The corpus pipeline: quality rules, near-duplicate removal, benchmark
decontamination, mixing to target weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet in the shared folder of the cluster and reads
it again as the next one's documents.  All but the last return the columns of
their input.  The first stage depends on a trained model and the fourth on
seeded draws, so the rows have no SQL form; the tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm import decontaminate, mixing, ngram_join, quality_rules, token_index
from textlens.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trained model keep."""
    model = quality_rules.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id (all
    rows with that id); documents without words or id are in no group and stay."""
    groups = ngram_join.near_duplicates(docs)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, each document as often as it is drawn."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids with their index, read back by key."""
    return token_index.token_table(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("token_index", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
