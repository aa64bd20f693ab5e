"""Sinks: appends, replay-safe batch appends, and status changes with a latest-wins read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.functions.ordered import first_rows


def append_table(rows: DataFrame, root: str, table: str, partition_by: list[str] | None = None) -> None:
    """Append rows, in folders by `partition_by` (a date for logs and appointments)."""
    rows.write.mode("append").partitionBy(*partition_by or []).parquet(f"{root}/{table}")


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Save as a catalog table bucketed by `key`, so that joins and groupings on the key
    between tables with the same number of buckets need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder; writing it again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(
    spark: SparkSession, path: str, schema: str, before: int | None = None
) -> DataFrame:
    """All written batches, or those before `before`; no rows where nothing is written yet."""
    try:
        rows = spark.read.schema(f"{schema}, batch_id long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch_id long")
    return rows if before is None else rows.where(F.col("batch_id") < before)


def append_status_changes(changes: DataFrame, root: str, table: str) -> None:
    """Append (id, status, changed_at) rows. Nothing already written is rewritten."""
    changes.select("id", "status", "changed_at").write.mode("append").parquet(
        f"{root}/{table}_status"
    )


def current_state(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The table with each row's latest status change applied."""
    latest = first_rows(changes, ["id"], [F.desc("changed_at"), F.desc("status")]).select(
        "id", F.col("status").alias("_status")
    )
    return (
        base.join(latest, "id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .select(*base.columns)
    )


def compact(state: DataFrame, path: str, version: int) -> str:
    """Write a new snapshot version beside the older ones and return its path."""
    target = f"{path}/version={version}"
    state.write.mode("overwrite").parquet(target)
    return target


#: Rows of a part of a table that is compacted part by part.
PART_ROWS = 1_000_000


def _part(part_rows: int) -> Column:
    return F.floor(F.col("id") / part_rows).cast("long")


def save_parts(rows: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Write a table in parts by ranges of its id, each as its first version."""
    placed = rows.withColumns({"part": _part(part_rows), "version": F.lit(0)})
    placed.repartition("part").write.partitionBy("part", "version").parquet(path)


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists a table's folders by one task for each, up to 10,000; here as many as a shuffle has do it."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """part, version: of each file, by its name; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.where("length > 0").select("part", "version")


def _newest(files: DataFrame, versions: DataFrame) -> DataFrame:
    """The rows of every part's newest version. These are one short row for each folder that the driver lists,
    so they are broadcast. Older versions are read too until they are removed, and their rows dropped here."""
    newest = versions.groupBy("part").agg(F.max("version").alias("version"))
    return files.join(F.broadcast(newest), ["part", "version"])


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A table of parts as it is now."""
    with _few_listing_tasks(spark):
        # Listed first: what is written between the two is not read.
        versions = _versions(spark, path)
        return _newest(spark.read.parquet(path), versions).drop("part", "version")


def compact_parts(
    spark: SparkSession, path: str, changes: DataFrame, part_rows: int = PART_ROWS
) -> int:
    """Apply status changes to the parts that hold a changed id, as their next version.

    Other parts are neither read nor written, and older versions stay for readers that have begun.
    A part whose writing is lost is written again from the same version. Returns the version
    written. Changes written before and applied again leave the same rows.
    """
    with _few_listing_tasks(spark):
        versions = _versions(spark, path)
        files = spark.read.parquet(path)
        version = versions.agg(F.max("version")).first()[0] + 1
        touched = changes.select(_part(part_rows).alias("part")).distinct()
        held = _newest(files, versions.join(touched, "part", "left_semi"))
        after = current_state(held, changes).withColumn("version", F.lit(version))
        # Appending lists the folders again.
        after.repartition("part").write.mode("append").partitionBy("part", "version").parquet(path)
    return version
