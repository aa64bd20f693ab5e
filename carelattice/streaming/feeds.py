"""Stateless and windowed streams: the HL7 feed and log latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions import hl7
from carelattice.operators.hl7 import records_of, validate_hl7, with_segments

QUANTILES = {"p50": 0.5, "p95": 0.95}
#: Size of a window's quantile sketch, and the rank error that follows from it.
SKETCH_ITEMS = 4_096
SKETCH_ERROR = 2.296 / SKETCH_ITEMS**0.9021


def _control_id() -> Column:
    """The message control id of the header segment, else the message's own id."""
    headers = F.filter(
        "_segments", lambda s: (hl7.segment_name(s) == "MSH") & (F.size(s) > 9)
    )
    control = F.get(F.get(headers, F.lit(0)), F.lit(9))
    return F.when(control != "", control).otherwise(F.col("message_id").cast("string"))


def _sender() -> Column:
    """Sending application and facility of the header segment: a control id is theirs alone."""
    headers = F.filter("_segments", lambda s: hl7.segment_name(s) == "MSH")
    header = F.get(headers, F.lit(0))
    return F.array(*[F.coalesce(F.get(header, F.lit(i)), F.lit("")) for i in (2, 3)])


def stream_records(
    messages: DataFrame, repeat_window: str = "1 hour", spread: int | None = None
) -> DataFrame:
    """Feed of messages (`message_id`, `message`, `arrived_at`) -> records with items.

    A control id of the same sender seen again within `repeat_window` is a resent message
    and is dropped: first within each of `spread` parts of its copies, by default as many as the session has
    shuffle partitions, then among what is left, so one message resent very often does not reach
    one task in full. Messages become records before that: what is shuffled are a record's
    fields and items, never segments.
    """
    accepted = validate_hl7(messages).where(F.col("reject_reason").isNull()).drop("reject_reason")
    parts = spread or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = (
        with_segments(accepted)
        .withColumn("control_id", _control_id())
        .withColumn("_sender", _sender())
    )
    return (
        records_of(named, with_items=True)
        .withColumn("_part", F.pmod(F.xxhash64("message_id"), F.lit(parts)))
        .withWatermark("arrived_at", repeat_window)
        .dropDuplicatesWithinWatermark(["_sender", "control_id", "_part"])
        .dropDuplicatesWithinWatermark(["_sender", "control_id"])
        .drop("_part", "_sender")
    )


def stream_rejects(messages: DataFrame) -> DataFrame:
    """The messages of the feed that are refused, with the reason."""
    return validate_hl7(messages).where(F.col("reject_reason").isNotNull())


def _latency_columns(sketch: Column) -> list[Column]:
    return [
        F.kll_sketch_get_quantile_double(sketch, F.lit(q)).alias(name) for name, q in QUANTILES.items()
    ]


def stream_latency(
    requests: DataFrame,
    window: str = "1 hour",
    late_by: str = "10 minutes",
    at: str = "answered_at",
) -> DataFrame:
    """Count, percentiles, maximum and quantile sketch per window, once the window is closed.

    The sketch (KLL) answers a quantile with a value whose rank is at most SKETCH_ERROR of the count
    off, in 99 of 100 cases, and exactly up to SKETCH_ITEMS values. It is kept with the window, so that windows
    merge: see `merge_latency`.
    """
    windows = (
        requests.withWatermark(at, late_by)
        .groupBy(F.window(at, window).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("elapsed_s").alias("max"),
            F.kll_sketch_agg_double("elapsed_s", SKETCH_ITEMS).alias("sketch"),
        )
    )
    return windows.select(
        F.col("_w.start").alias("window_start"), "n", *_latency_columns(F.col("sketch")), "max", "sketch"
    )


def merge_latency(windows: DataFrame, window: str) -> DataFrame:
    """The rows of `stream_latency` put together to longer windows, without their requests."""
    merged = windows.groupBy(F.window("window_start", window).alias("_w")).agg(
        F.sum("n").alias("n"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", SKETCH_ITEMS).alias("sketch"),
    )
    return merged.select(
        F.col("_w.start").alias("window_start"), "n", *_latency_columns(F.col("sketch")), "max", "sketch"
    )
