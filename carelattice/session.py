"""Session settings and the shared work folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def build_session(app_name: str = "carelattice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE with skew-join splitting, and Arrow transfer."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Small shuffles of heavy rows still spread over the cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A JSON object that repeats a key means its last value.
        "spark.sql.variant.allowDuplicateKeys": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return os.path.join(work_folder(spark), f"{label}-{uuid.uuid4().hex}")


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = "2m"


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers end by their bytes too, not by Spark's number of rows alone: whole texts of
    thousands of rows would stand in a worker and in its executor at once. A setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    The result no longer depends on its upstream stages, so a lost executor
    costs a re-read and not a recomputation of every earlier round.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver forget what no result needs any more: Spark then deletes those steps' shuffle files,
    which would otherwise stay on disk until the driver's memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_tables(*tables: DataFrame) -> None:
    """Delete what `cut_lineage` has written, once no result reads it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
