"""The cleaning chain over Structured Streaming.

Every cleaning step is a stateless column expression, so the same functions
run unchanged on a stream: ``readStream`` -> preprocess (+ optional later
steps) -> a parquet sink with a checkpoint location in the shared checkpoint
folder (exactly-once file sink, restartable after executor or driver loss).
No state store is involved; keep-last duplicate removal stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_path
from ..sources.tables import SCHEMAS, path


def clean_stream(spark: SparkSession, source_dir: str, table: str = "documents",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of (row_id, lang, textclean) from a table: one
    parquet file, or a folder of part files that may grow."""
    r = spark.readStream.schema(SCHEMAS[table])
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # as a pattern: a plain path to a single file is refused by the stream source
    s = r.parquet(path(source_dir, table)[:-1] + "[t]")
    return s.select(F.col("doc_id").alias("row_id"), "lang", T.clean_preprocess("text").alias("textclean"))


def run_to_parquet(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> str:
    """Drain everything available into a parquet sink and stop."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream_out")
    checkpoint = checkpoint or scratch_path(spark, "stream_ckpt")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out
