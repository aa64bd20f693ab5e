"""Streams whose outcome depends on earlier batches: bookings and id walks.

The state is an ordinary table with one folder per micro-batch in shared storage.
A batch reads the folders before it, runs the batch operator, and writes its own
folder; a replayed batch writes the same folder again, so nothing is counted twice.
Each batch is a normal Spark job: a slot or principal with most of its rows is
reduced before the shuffle or spread over tasks, which per-key state could not do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelattice.functions.ordered import SPLIT_ABOVE, first_rows
from carelattice.operators.compliance import walk_runs
from carelattice.operators.writes import resolve_bookings
from carelattice.sources.sinks import read_batches, write_batch

_OUTCOMES = "request_id {id}, slot_id {slot}, requested_at timestamp, outcome string"
_READS = (
    "principal {id}, at timestamp, seq {seq}, first_at timestamp, first_id {key}, id {key},"
    " n_reads long"
)


def _types(df: DataFrame, **columns: str) -> dict[str, str]:
    return {name: df.schema[column].dataType.simpleString() for name, column in columns.items()}


def booking_outcomes(requests: DataFrame, prior: DataFrame, appointments: DataFrame) -> DataFrame:
    """Outcomes of the requests not decided before. `request_id` is the idempotency key:
    a repeat within the batch counts once, a repeat of an earlier batch not at all."""
    fresh = first_rows(requests, ["request_id"], [F.asc("requested_at")]).join(
        prior.select("request_id"), "request_id", "left_anti"
    )
    held = appointments.select("slot_id", "status").unionByName(
        prior.where(F.col("outcome") == "confirmed").select(
            "slot_id", F.lit("confirmed").alias("status")
        )
    )
    return resolve_bookings(fresh, held).select("request_id", "slot_id", "requested_at", "outcome")


def start_bookings(
    requests: DataFrame, appointments: DataFrame, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Decide booking requests as they arrive; outcomes go to `path`.

    Batches are decided in order of arrival, requests of one batch by request time.
    """
    schema = _OUTCOMES.format(**_types(requests, id="request_id", slot="slot_id"))

    def decide(batch: DataFrame, batch_id: int) -> None:
        prior = read_batches(batch.sparkSession, path, schema, before=batch_id)
        batch.persist()  # read several times
        try:
            write_batch(booking_outcomes(batch, prior, appointments), path, batch_id)
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def booking_results(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    schema = _OUTCOMES.format(**_types(requests, id="request_id", slot="slot_id"))
    return read_batches(spark, path, schema).drop("batch_id")


# Every so many batches the state table holds all principals again, so a batch reads
# at most this many state folders.
FULL_STATE_EVERY = 50


def _last_run(runs: DataFrame, latest: list) -> DataFrame:
    return first_rows(runs, ["principal"], [*latest, F.desc("at"), F.desc("seq")])


def start_walk_alerts(
    reads: DataFrame,
    path: str,
    checkpoint: str,
    split_above: int = SPLIT_ABOVE,
    **trigger,
) -> StreamingQuery:
    """Follow id walks over access events (shape of `compliance.as_reads`).

    A batch writes its runs to `path`/runs and the last run of each of its principals to
    `path`/state, where the next batches find it. A run that goes on appears again under
    the same start: see `walk_alerts`.
    """
    schema = _READS.format(**_types(reads, id="principal", seq="seq", key="id"))

    def follow(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read several times
        try:
            walk(batch, batch_id)
        finally:
            batch.unpersist()

    def walk(batch: DataFrame, batch_id: int) -> None:
        earlier = read_batches(batch.sparkSession, f"{path}/state", schema, before=batch_id)
        full = max(batch_id - 1, 0) // FULL_STATE_EVERY * FULL_STATE_EVERY
        state = _last_run(earlier.where(F.col("batch_id") >= full), [F.desc("batch_id")]).drop(
            "batch_id"
        )
        present = batch.select("principal").distinct()
        carried = state.join(present, "principal", "left_semi").select(*batch.columns)
        write_batch(walk_runs(batch.unionByName(carried), split_above), f"{path}/runs", batch_id)
        runs = read_batches(batch.sparkSession, f"{path}/runs", schema)
        now = _last_run(runs.where(F.col("batch_id") == batch_id), []).drop("batch_id")
        if batch_id % FULL_STATE_EVERY == 0:
            absent = state.join(present, "principal", "left_anti")
            now = now.unionByName(absent.select(*now.columns))
        write_batch(now, f"{path}/state", batch_id)

    return (
        reads.writeStream.foreachBatch(follow)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def walk_alerts(spark: SparkSession, path: str, reads: DataFrame, min_run: int = 3) -> DataFrame:
    """The runs found so far, each at its longest, in the shape of `id_walk_detection`."""
    schema = _READS.format(**_types(reads, id="principal", seq="seq", key="id"))
    return (
        read_batches(spark, f"{path}/runs", schema)
        .groupBy("principal", "first_at", "first_id")
        .agg(
            F.max("at").alias("last_at"),
            F.max("id").alias("last_id"),
            F.max("n_reads").alias("n_reads"),
        )
        .where(F.col("n_reads") >= min_run)
    )
