"""Disclosure accounting, access reports, id walks, sensitive text, breach scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.intervals import overlapping
from carelattice.functions.ordered import SPLIT_ABOVE, Ordered
from carelattice.functions.text import PHI_PATTERNS, find_phi, live_rows, redact
from carelattice.session import cut_lineage

# Breach notification rules.
MEDIA_THRESHOLD = 500
NOTICE_DAYS = 60
# Report periods.
ACCOUNTING_YEARS = 6
ACCESS_DAYS = 90


def accounting_of_disclosures(
    disclosures: DataFrame, roi_requests: DataFrame, as_of: Column, years: int = ACCOUNTING_YEARS
) -> DataFrame:
    """Releases of the past `years`: when, to whom, on whose request and why.

    No table holds an authorization, so `authorization_missing` is always true.
    Unlinked disclosures are kept and skip the join, so they never share a null key.
    """
    since = F.add_months(as_of, -12 * years)
    recent = disclosures.where(
        (F.to_date("disclosed_at") >= since) & (F.col("disclosed_at") <= as_of)
    )
    requests = roi_requests.select(
        F.col("id").alias("roi_request_id"), "requested_by", "purpose"
    )
    linked = recent.where(F.col("roi_request_id").isNotNull()).join(
        requests, "roi_request_id", "left"
    )
    unlinked = recent.where(F.col("roi_request_id").isNull())
    return linked.unionByName(unlinked, allowMissingColumns=True).withColumn(
        "authorization_missing", F.lit(True)
    )


def _asked(roi_requests: DataFrame) -> DataFrame:
    """Requests with their range as dates; a missing or unreadable bound is null: open."""
    return roi_requests.select(
        F.col("id").alias("request_id"),
        "patient_id",
        F.col("date_range_start").try_cast("date").alias("_from"),
        F.col("date_range_end").try_cast("date").alias("_to"),
    )


def _without_range() -> Column:
    return F.col("_from").isNull() & F.col("_to").isNull()


def _of_asked(records: DataFrame, asked: DataFrame) -> DataFrame:
    """The records of patients that requests name. Spark puts this below the joins that make the records."""
    named = asked.select("patient_id").distinct()
    return records.join(named, "patient_id", "left_semi").select(*records.columns)


def minimum_necessary_packet(roi_requests: DataFrame, records: DataFrame) -> DataFrame:
    """Per request, only the patient's records inside the requested date range.

    Records and ranges meet in the order of their days (see `overlapping`): a range of
    fifty years costs no more than one of a day, but for the records it finds. A record without a date
    is inside a request without a range, and in no other.
    """
    asked = _asked(roi_requests)
    dated = _of_asked(records, asked).withColumn("_day", F.to_date("created_at"))
    inside = overlapping(dated, asked, ["patient_id"], ("_day", None), ("_from", "_to")).select(
        F.col("_right_request_id").alias("request_id"),
        *[F.col(f"_left_{c}").alias(c) for c in records.columns],
    )
    whole = asked.where(_without_range()).select("request_id", "patient_id")
    undated = records.where(F.col("created_at").isNull()).join(whole, "patient_id")
    return inside.unionByName(undated.select("request_id", *records.columns))


def excess_release(
    roi_requests: DataFrame, records: DataFrame, split_above: int = SPLIT_ABOVE
) -> DataFrame:
    """Per request: records released, records inside the range, and the excess.

    Records are counted per patient and day, written once; the range bounds are set
    among the days and a running sum is read at each bound. The work is linear in requests and days,
    however many of both one patient has.
    """
    asked = _asked(roi_requests)
    daily = cut_lineage(
        records.groupBy("patient_id", F.to_date("created_at").alias("_day")).agg(
            F.count(F.lit(1)).alias("_rows")
        ),
        "daily",
    )
    totals = daily.groupBy("patient_id").agg(
        F.sum("_rows").alias("_released"),
        F.sum(F.when(F.col("_day").isNotNull(), F.col("_rows"))).alias("_dated"),
    )
    bounds = asked.select(
        "patient_id", "request_id",
        F.inline(
            F.array(
                F.struct(F.col("_from").alias("_day"), F.lit(0).alias("_place")),
                F.struct(F.col("_to").alias("_day"), F.lit(2).alias("_place")),
            )
        ),
    )
    days = daily.withColumn("_place", F.lit(1))
    line = bounds.unionByName(days, allowMissingColumns=True).where(F.col("_day").isNotNull())
    counted = (
        Ordered(line, ["patient_id"], ["_day", "_place", "request_id"], split_above=split_above)
        .running_sum("_upto", F.coalesce("_rows", F.lit(0)))
        .frame()
        .where(F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(
            F.max(F.when(F.col("_place") == 0, F.col("_upto"))).alias("_before"),
            F.max(F.when(F.col("_place") == 2, F.col("_upto"))).alias("_until"),
        )
    )
    none = F.lit(0).cast("long")
    until = F.coalesce("_until", F.when(F.col("_whole"), F.col("_released")), "_dated", none)
    return (
        asked.select("request_id", "patient_id", _without_range().alias("_whole"))
        .join(totals, "patient_id", "left")
        .join(counted, "request_id", "left")
        .select(
            "request_id",
            "patient_id",
            F.coalesce("_released", none).alias("n_released"),
            F.greatest(until - F.coalesce("_before", none), none).alias("n_in_range"),
        )
        .withColumn("n_excess", F.col("n_released") - F.col("n_in_range"))
    )


def parse_audit(audit_logs: DataFrame) -> DataFrame:
    """Audit messages -> method, path, patient id and status; unparsed parts are null."""
    def part(regex: str) -> Column:
        return F.nullif(F.regexp_extract("message", regex, 1), F.lit(""))

    return audit_logs.select(
        "*",
        part("^([A-Z]+) /").alias("method"),
        part("^[A-Z]+ (/[^ ?]*)").alias("path"),
        part("^[A-Z]+ /patients/([0-9]+)(?:[/? ]|$)").try_cast("long").alias("patient_id"),
        part("^[A-Z]+ /[^ ]* ([0-9]{3})(?: |$)").cast("int").alias("status"),
    )


def chart_access_report(audit_logs: DataFrame, as_of: Column, days: int = ACCESS_DAYS) -> DataFrame:
    """Who read or changed which chart when, over the last `days`, deleted rows left out.

    The actor is the service that wrote the line, never a person.
    """
    recent = audit_logs.where(
        live_rows(F.col("deleted_at"))
        & (F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
        & (F.col("created_at") <= as_of)
    )
    return (
        parse_audit(recent)
        .where(F.col("patient_id").isNotNull())
        .select(
            "actor",
            F.lit("service").alias("actor_kind"),
            "patient_id",
            F.concat_ws(" ", "method", "path").alias("action"),
            "created_at",
        )
    )


def walk_runs(reads: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Runs of consecutive ids per principal.

    `reads` has one row per read or per run read before: (principal, at, seq,
    first_at, first_id, id, n_reads). A run goes on while a row starts at the id
    that follows the previous row's. The running run number crosses task borders
    (see `Ordered`), so a principal with most of the reads is spread over tasks.
    """
    ordered = Ordered(reads, ["principal"], ["at", "seq"], split_above=split_above)
    ordered.previous(_previous_id="id")
    starts = F.when(F.col("first_id") == F.col("_previous_id") + 1, 0).otherwise(1)
    ordered.running_sum("_run_number", starts)
    return (
        ordered.frame()
        .groupBy("principal", "_run_number")
        .agg(
            F.min("first_at").alias("first_at"),
            F.max("at").alias("at"),
            F.max("seq").alias("seq"),
            F.min("first_id").alias("first_id"),
            F.max("id").alias("id"),
            F.sum("n_reads").alias("n_reads"),
        )
        .drop("_run_number")
    )


def as_reads(events: DataFrame, principal: str, at: str, seq: str, id: str) -> DataFrame:
    """Access events in the shape `walk_runs` takes."""
    return events.select(
        F.col(principal).alias("principal"),
        F.col(at).alias("at"),
        F.col(seq).alias("seq"),
        F.col(at).alias("first_at"),
        F.col(id).alias("first_id"),
        F.col(id).alias("id"),
        F.lit(1).cast("long").alias("n_reads"),
    )


def id_walk_detection(
    reads: DataFrame, min_run: int = 3, split_above: int = SPLIT_ABOVE
) -> DataFrame:
    """Runs in which one principal read ids n, n+1, n+2 ... one after the other."""
    return (
        walk_runs(reads, split_above)
        .where(F.col("n_reads") >= min_run)
        .select(
            "principal", "first_at", F.col("at").alias("last_at"), "first_id",
            F.col("id").alias("last_id"), "n_reads",
        )
    )


def foreign_chart_requests(entries: DataFrame) -> DataFrame:
    """Captured requests whose token belongs to another patient than the path names."""
    token_of = F.regexp_extract("authorization", "patient-([0-9]+)-token", 1)
    path_of = F.regexp_extract("url", "/patients/([0-9]+)(?:[/?#]|$)", 1)
    return (
        entries.withColumn("token_patient_id", F.when(token_of != "", token_of).try_cast("long"))
        .withColumn("path_patient_id", F.when(path_of != "", path_of).try_cast("long"))
        .where(F.col("token_patient_id") != F.col("path_patient_id"))
    )


def scan_phi(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per row, column and kind with sensitive values: how many and which."""
    checks = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind).alias("kind"),
                find_phi(F.col(c), kind).alias("found"),
            )
            for c in columns
            for kind in PHI_PATTERNS
        ]
    )
    return (
        df.select(*keep, F.inline(checks))
        .where(F.size("found") > 0)
        .withColumn("n_found", F.size("found").cast("long"))
    )


def redact_phi(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with every sensitive value in `columns` masked."""
    return df.withColumns({c: redact(F.col(c)) for c in columns})


def breach_scale(affected: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident: distinct patients, whether media and the Secretary must be told,
    and the last day for notice."""
    counts = affected.groupBy("incident_id").agg(
        F.count_distinct("patient_id").alias("n_patients")
    )
    n = F.coalesce("n_patients", F.lit(0).cast("long"))
    return incidents.join(counts, "incident_id", "left").select(
        *incidents.columns,
        n.alias("n_patients"),
        (n >= MEDIA_THRESHOLD).alias("notify_media"),
        F.date_add(F.to_date("discovered_at"), NOTICE_DAYS).alias("notice_deadline"),
    )
