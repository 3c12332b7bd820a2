"""Spark session and cluster-wide settings.

Library code never creates its own session; it receives one.  ``get_session``
is for scripts, tests and the bench, and only fills settings that are unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that shape the physical plans of this library at scale:
#  * AQE re-plans joins from runtime sizes (broadcasts only what was measured
#    small), coalesces tiny shuffle partitions and splits skewed ones (a hot
#    token such as "the" can hold a large share of exploded rows).
#  * ANSI stays on (Spark 4 default); code uses try_* accessors where a miss is
#    expected.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "textlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", _driver_memory())
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _driver_memory(cap_gb: int = 16) -> str:
    """Local mode: the driver JVM is the whole cluster; use about 60% of the
    machine's memory, at most ``cap_gb``."""
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("MemTotal"))
        gb = max(1, min(cap_gb, int(kb / 1024 / 1024 * 0.6)))
    except (OSError, StopIteration, ValueError):
        gb = 4
    return f"{gb}g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only under a ``local`` master (tests) may it be unset; then a
    scratch folder is made.  Elsewhere a machine-local folder would lose files.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="textlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Reliable checkpoint to the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_file(df) -> str | None:
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    at = plan.rdd().getCheckpointFile()
    return at.get() if at.isDefined() else None


def is_cut(df) -> bool:
    """Whether a table is one that ``cut_lineage`` returned, as it is."""
    return _checkpoint_file(df) is not None


def drop_checkpoint(df) -> None:
    """Delete the files of a table that ``cut_lineage`` returned, once nothing
    reads it or what was made from it (unless that was cut off itself)."""
    _delete(df.sparkSession.sparkContext, _checkpoint_file(df))


def store(df, name: str, partition: str | None = None, plain: bool = False):
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is
    cut, and ``drop_stored`` can delete the files once nothing reads them.
    ``plain`` files are neither compressed nor coded by dictionary, for columns
    of numbers that neither makes smaller."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition) if partition else df.write
    if plain:
        writer = writer.option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df) -> None:
    """Delete the files of a table that ``store`` returned."""
    _delete(df.sparkSession.sparkContext, df.stored_at)


def _delete(sc, at: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
