"""Latency windows and the reach of outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.intervals import overlapping
from carelattice.functions.ordered import SPLIT_ABOVE, Ordered
from carelattice.session import cut_lineage


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Exact interpolated quantiles, count and maximum per key.

    Equal values are counted before the shuffle and ranked by a running sum that
    crosses task borders, so no task holds all values of a large group.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    placed = (
        Ordered(counts, keys, [value], split_above=split_above)
        .running_sum("_upto", F.col("_c"))
        .total("n", F.col("_c"))
        .frame()
    )

    def at(rank: Column) -> Column:
        holds = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
        return F.max(F.when(holds, F.col(value)))

    marks = []
    for name, q in quantiles.items():
        rank = F.lit(q) * (F.col("n") - 1)
        marks += [at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}")]
    found = placed.groupBy(*keys, "n").agg(*marks, F.max(value).alias("max"))

    def between(name: str, q: float) -> Column:
        rank = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (rank - F.floor(rank))).alias(name)

    return found.select(
        *keys, "n", *[between(name, q) for name, q in quantiles.items()], "max"
    )


def pair_intake(log: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Each logged registration with the request it answers, in the same file.

    The log names no request, so answers are taken to come in the order of the requests: an answer
    belongs to the oldest request that is still open, also where requests interleave; where none is
    open, `requested_at` and `request_body` are null. Any status answers. `started_at` is the response time
    less the logged elapsed time. Lines of one time are ordered by status and message, requests
    first.

    The walk of open requests is a running sum; answers without a request are its new lows below
    zero, and the n-th other answer meets the n-th request in an equi-join. The log is read more than
    once: give this a stored table of parsed lines, not lines still to be parsed.
    """
    lines = log.where((F.col("method") == "POST") & (F.col("path") == "/intake"))
    answers = F.col("status").isNotNull()
    ordered = Ordered(lines, ["source"], ["ts", "status", "message"], split_above=split_above)
    ordered.running_sum("_open", F.when(answers, -1).otherwise(1))
    ordered.running_sum("_requests", F.when(answers, 0).otherwise(1))
    ordered.running_min("_low", F.col("_open"))
    ordered.previous(_low_before="_low")
    walked = cut_lineage(ordered.frame(), "intake-lines")
    # So many answers had no request, up to and with this line.
    lone = F.greatest(-F.col("_low"), F.lit(0).cast("long"))
    lone_before = F.greatest(-F.coalesce("_low_before", F.lit(0).cast("long")), F.lit(0).cast("long"))
    answered = F.col("_requests") - F.col("_open")
    nth = F.when(lone == lone_before, answered - lone)
    requests = walked.where(~answers).select(
        "source", F.col("_requests").alias("_nth"), F.col("body").alias("request_body"),
        F.col("ts").alias("requested_at"),
    )
    paired = walked.where(F.col("status") == 201).withColumn("_nth", nth).join(
        requests, ["source", "_nth"], "left"
    )
    return paired.select(
        "source",
        F.col("ts").alias("answered_at"),
        "requested_at",
        "request_body",
        "patient_id",
        "elapsed_s",
        (F.col("ts") - F.make_dt_interval(secs=F.col("elapsed_s").cast("decimal(18,6)"))).alias(
            "started_at"
        ),
    )


def latency_windows(
    requests: DataFrame,
    window: str = "1 hour",
    slow_seconds: float = 30.0,
    at: str = "answered_at",
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Count, median, 95th percentile and maximum per tumbling window."""
    windowed = requests.select(F.window(at, window).alias("_w"), "elapsed_s").select(
        F.col("_w.start").alias("window_start"), "elapsed_s"
    )
    quantiles = {"p50": 0.5, "p95": 0.95}
    found = exact_quantiles(windowed, ["window_start"], "elapsed_s", quantiles, split_above)
    return found.withColumn("slow", F.col("p95") > slow_seconds)


def outage_impact(
    incidents: DataFrame, requests: DataFrame, ranges: int | None = None
) -> DataFrame:
    """(incident, request) where the request's time overlaps the incident's.

    Both are put in one order of their times (see `overlapping`), so the work does not depend on how
    long an outage lasts. Incidents: incident_id, start_at, end_at. Requests: request_id,
    started_at, elapsed_s.
    """
    seconds = F.make_dt_interval(
        secs=F.greatest(F.coalesce("elapsed_s", F.lit(0.0)), F.lit(0.0)).cast("decimal(18,6)")
    )
    asked = requests.where(F.col("started_at").isNotNull()).withColumn(
        "_ended_at", F.col("started_at") + seconds
    )
    down = incidents.select("incident_id", "start_at", "end_at").where("start_at <= end_at")
    return overlapping(
        asked, down, [], ("started_at", "_ended_at"), ("start_at", "end_at"), ranges
    ).select(
        F.col("_right_incident_id").alias("incident_id"),
        *[F.col(f"_left_{c}").alias(c) for c in requests.columns],
    )
