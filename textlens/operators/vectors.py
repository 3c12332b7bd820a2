"""Word vectors and document vectors.

Document vectors are means over in-vocabulary tokens only (zeros when none),
not ``Word2VecModel.transform`` which divides by all tokens.  Documents are
dealt into groups, and a group meets the vector of each of its words once: what
moves is a vector per word and group, not per token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..session import cut_lineage, drop_checkpoint, is_cut

#: Tokens of a group of documents, and the fewest where there are tasks for more groups.
GROUP_TOKENS, LEAST_TOKENS = 8_000_000, 100_000
#: Tokens whose vectors are added up at once.
SLICE = 1 << 15


def hashed_id(tok: Column, modulus: int) -> Column:
    """A stable id for a token: the first 32 bits of its md5, mod ``modulus``."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(modulus))


def token_vectors(tokens: DataFrame, embeddings: DataFrame, modulus: int) -> DataFrame:
    """(word, vector): stand-in word vectors -- each distinct token maps to
    an embedding row by a fixed modulus; ids with no row leave the token
    out of the vocabulary."""
    t = tokens.select(F.col("tok").alias("word")).distinct().withColumn("vec_id", hashed_id(F.col("word"), modulus))
    return t.join(embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("word", "vector")


def doc_mean_vector(df: DataFrame, tokens: str, vectors: DataFrame, dim: int, key: str = "row_id",
                    out: str = "features") -> DataFrame:
    """(key, n_known, out ARRAY<DOUBLE>): mean of the vectors of the known
    tokens; a document with none gets zeros of length ``dim``.  Rows of one key
    share their tokens.  ``df`` is read three times, so give it cut off from
    work that should run once."""
    n = df.agg(F.sum(F.size(tokens))).first()[0] or 0
    groups = max(1, -(-n // GROUP_TOKENS), min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST_TOKENS))
    docs = (df.where(F.col(key).isNotNull())
            .select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_g"), F.col(key).alias("_k"), F.col(tokens).alias("_t"))
            .repartition(groups, "_g"))
    words = docs.select("_g", F.explode("_t").alias("word")).distinct()
    held = words.join(vectors.select("word", "vector"), "word").select(F.col("_g").alias("_h"), "word", "vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, n_known, means = _group_means(left, right, dim)
        ends = pa.array(np.arange(0, means.size + 1, dim), pa.int32())
        return pa.table([keys, pa.array(n_known, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(means.ravel()))], names=names)

    names = [key, "n_known", out]
    kind = df.select(key).schema[0].dataType.simpleString()
    found = docs.groupBy("_g").cogroup(held.groupBy("_h")).applyInArrow(run, f"`{key}` {kind}, n_known long, `{out}` array<double>")
    nameless = df.where(F.col(key).isNull()).select(key, F.lit(0).cast("long").alias("n_known"), F.array_repeat(F.lit(0.0), dim).alias(out))
    return found.unionByName(nameless)


def _group_means(docs: pa.Table, held: pa.Table, dim: int):
    """The keys of some documents, their numbers of known tokens and their mean
    vectors; a word with several vectors counts with each."""
    if held.column("vector").null_count:
        raise ValueError("a word has no vector")
    vectors = held.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    words = held.column("word").combine_chunks().dictionary_encode()
    of, words = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    times = np.bincount(of, minlength=len(words))
    if len(words) < len(of):
        both = np.zeros((len(words), dim))
        np.add.at(both, of, vectors)
        vectors = both
    keys = docs.column("_k").combine_chunks()
    row = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    toks = docs.column("_t").combine_chunks()
    doc = np.repeat(row, pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False))
    code = pc.fill_null(pc.index_in(toks.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
    doc, code = doc[code >= 0], code[code >= 0]
    order = np.argsort(doc, kind="stable")
    doc, code = doc[order], code[order]
    n = np.bincount(doc, times[code], int(row.max(initial=-1)) + 1)
    sums = np.zeros((len(n), dim))
    for lo in range(0, len(doc), SLICE):
        part = doc[lo:lo + SLICE]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        sums[part[first]] += np.add.reduceat(vectors[code[lo:lo + SLICE]].astype(np.float64), first, axis=0)
    sums /= np.maximum(n, 1)[:, None]
    return keys, n[row].astype(np.int64), sums[row]


class StageWriter(MLWriter):
    """Writes a stage's parameters and the table it carries, if any."""

    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        if self.stage.carried() is not None:
            self.stage.carried().write.parquet(f"{path}/table")


class StageReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        if self.kind.CARRIES:
            stage.carry(self.sparkSession.read.parquet(f"{path}/table"))
        return stage


class StoredStage(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """A stage that can be stored, alone or inside a pipeline: its parameters as
    metadata and, where it ``CARRIES`` one, a table beside them."""

    CARRIES = False

    def carry(self, table: DataFrame):
        self.table = table
        return self

    def carried(self) -> DataFrame | None:
        return getattr(self, "table", None)

    def write(self) -> MLWriter:
        return StageWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return StageReader(cls)


class MeanEmbedding(StoredStage):
    """Pipeline stage: token array -> mean in-vocabulary word vector."""

    CARRIES = True
    dim = Param(Params._dummy(), "dim", "length of the vectors", TypeConverters.toInt)
    key = Param(Params._dummy(), "key", "column that names a row", TypeConverters.toString)

    def __init__(self, vectors: DataFrame = None, dim: int = 0, inputCol: str = "toks",
                 outputCol: str = "features", key: str = "row_id"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, dim=dim, key=key)
        self.carry(vectors)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = self.getOrDefault(self.key)
        held = dataset if is_cut(dataset) else cut_lineage(dataset)
        m = doc_mean_vector(held, self.getInputCol(), self.carried(), self.getOrDefault(self.dim), key, "_mean")
        out = held.join(m.select(key, "_mean", *(["n_known"] if "n_known" not in dataset.columns else [])), key, "left")
        # a classifier behind this stage reads its rows several times
        out = cut_lineage(out.withColumn(self.getOutputCol(), array_to_vector(F.col("_mean"))).drop("_mean"))
        if held is not dataset:  # its rows are in the output
            drop_checkpoint(held)
        return out


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (na * nb)


def nearest_terms(vectors: DataFrame, query_word: str, k: int = L.NEAREST_TOPN,
                  word: str = "word", vec: str = "vector") -> DataFrame:
    """Top-k words by cosine to ``query_word``'s vector.  The one query
    vector is fetched and inlined as a literal; the scan is a top-k."""
    row = vectors.filter(F.col(word) == query_word).select(vec).first()
    if row is None:
        return vectors.limit(0).select(word, F.lit(None).cast("double").alias("similarity"))
    q = F.array(*[F.lit(float(x)) for x in row[0]])
    c = vectors.filter(F.col(word) != query_word).select(word, cosine(F.col(vec), q).alias("similarity"))
    return c.orderBy(F.desc("similarity"), word).limit(k)


class CleanTokenizer(StoredStage):
    """Pipeline stage: raw text -> cleaned word tokens (preprocess, squeeze,
    printable, word tokenizer), all native column expressions."""

    def __init__(self, inputCol: str = "text", outputCol: str = "toks"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from ..functions import text as T
        from ..functions import tokens as K
        c = T.txt_printable(T.txt_squeeze_runs(T.clean_preprocess(F.col(self.getInputCol()))))
        return dataset.withColumn(self.getOutputCol(), K.tok_words(c))


class PhraseMerger(StoredStage):
    """Pipeline stage: token array -> token array with its phrases merged."""

    CARRIES = True
    key = Param(Params._dummy(), "key", "column that names a row", TypeConverters.toString)

    def __init__(self, phrases: DataFrame = None, inputCol: str = "toks", outputCol: str = "merged", key: str = "row_id"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, key=key)
        self.carry(phrases)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from .topics import phrase_apply
        out, key = self.getOutputCol(), self.getOrDefault(self.key)
        found = phrase_apply(dataset.select(key, F.col(self.getInputCol()).alias(out)), out, self.carried(), key=key)
        return dataset.drop(out).join(found, key, "left")


class TopicShares(StoredStage):
    """Pipeline stage: token array -> topic shares, by a topic model that is
    carried as a table (one row per topic, one with the terms)."""

    CARRIES = True
    key = Param(Params._dummy(), "key", "column that names a row", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "prior of the topics' shares", TypeConverters.toString)

    def __init__(self, model=None, spark=None, inputCol: str = "merged", outputCol: str = "shares", key: str = "row_id"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, key=key)
        if model is not None:
            self._set(alpha=str(model.setting.alpha))
            rows = [(t, x.tolist(), None) for t, x in enumerate(model.topics)] + [(-1, None, model.terms)]
            self.carry(spark.createDataFrame(rows, "topic int, weights array<double>, terms array<string>"))

    def model(self):
        from .topic_models import Setting, TopicModel
        rows = self.carried().orderBy("topic").collect()  # the topics of one model and its terms
        alpha = self.getOrDefault(self.alpha)
        topics = np.asarray([r["weights"] for r in rows[1:]])
        return TopicModel(topics, Setting(len(topics), alpha if alpha in ("symmetric", "asymmetric") else float(alpha)), rows[0]["terms"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from .topic_models import bags_of
        key, model = self.getOrDefault(self.key), self.model()
        bags = bags_of(dataset.select(key, self.getInputCol()), self.getInputCol(), model.dictionary(dataset.sparkSession), key)
        return dataset.join(model.infer(bags, key).withColumnRenamed("shares", self.getOutputCol()), key, "left")
