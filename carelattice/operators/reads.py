"""Read operators: searches, lookups, listings and the portal's selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice import schemas
from carelattice.functions.ordered import Ordered, first_rows
from carelattice.functions.text import (
    contains_pattern,
    is_result,
    status_not_in,
    status_variant,
)

# Page bounds and defaults.
PATIENT_PAGE = {"limit": 25, "max_limit": 100}
SLOT_PAGE = {"limit": 50, "max_limit": 200}
# Statuses that end an appointment, a slot or a release request.
CLOSED_APPOINTMENT = ("cancelled", "canceled", "completed")
CLOSED_SLOT = ("booked", "cancelled", "canceled", "unavailable")
CLOSED_ROI = ("fulfilled", "completed", "denied")


def _page_bounds(limit: int | None, offset: int, bounds: dict[str, int]) -> int:
    limit = bounds["limit"] if limit is None else limit
    if not 1 <= limit <= bounds["max_limit"]:
        raise ValueError(f"limit must be between 1 and {bounds['max_limit']}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return limit


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that `df` has, in listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def _matching_patients(patients: DataFrame, q: str | None) -> DataFrame:
    return patients.where(F.col("name").ilike(contains_pattern(q))) if q else patients


def patient_search(
    patients: DataFrame, q: str | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """One page of the patients whose name contains `q`, by id."""
    limit = _page_bounds(limit, offset, PATIENT_PAGE)
    found = _shown(_matching_patients(patients, q), schemas.PATIENT_SUMMARY)
    return found.orderBy("id").offset(offset).limit(limit)


def patient_search_total(patients: DataFrame, q: str | None = None) -> DataFrame:
    """How many patients match, over all pages."""
    return _matching_patients(patients, q).agg(F.count(F.lit(1)).alias("total"))


def patient_lookup(patients: DataFrame, ids: DataFrame) -> DataFrame:
    """Each requested id with its patient row; `found` is false for an unknown id."""
    detail = _shown(patients, schemas.PATIENT_DETAIL).withColumn("found", F.lit(True))
    return (
        ids.select("id").distinct()
        .join(detail, "id", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def open_slots(
    slots: DataFrame,
    providers: DataFrame,
    provider_id: int | None = None,
    limit: int | None = None,
    offset: int = 0,
    order: tuple[str, ...] = ("start_at", "id"),
) -> DataFrame:
    """One page of open slots by start time, with the provider's name where known.

    The page is cut before the join: provider ids are unique, so the left join
    neither adds nor drops rows.
    """
    limit = _page_bounds(limit, offset, SLOT_PAGE)
    found = slots.where(F.col("status") == "open")
    if provider_id is not None:
        found = found.where(F.col("provider_id") == provider_id)
    page = found.orderBy(*order).offset(offset).limit(limit)
    names = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider"))
    joined = page.join(names, "provider_id", "left").orderBy(*order)
    return _shown(joined, schemas.SLOT_OUT)


def appointments_for(
    appointments: DataFrame, ids: DataFrame, order: tuple[str, ...] = ("created_at", "id")
) -> DataFrame:
    """The requested patients' appointments with their place, most recent first."""
    wanted = ids.select("patient_id").distinct()
    rows = appointments.join(wanted, "patient_id")
    return Ordered(rows, ["patient_id"], list(order), descending=True).number("place").frame()


def roi_requests_list(roi_requests: DataFrame, patient_id: int | None = None) -> DataFrame:
    """Release requests, newest id first, of one patient or of all."""
    if patient_id is not None:
        if patient_id <= 0:
            raise ValueError("patient_id must be positive")
        roi_requests = roi_requests.where(F.col("patient_id") == patient_id)
    return roi_requests.orderBy(F.desc("id"))


def next_appointment(appointments: DataFrame, closed: tuple[str, ...] = CLOSED_APPOINTMENT) -> DataFrame:
    """Each patient's earliest appointment that is not closed; one without a time comes first."""
    upcoming = appointments.where(status_not_in(F.col("status"), *closed))
    return first_rows(
        upcoming, ["patient_id"], [F.asc_nulls_first("scheduled_for"), F.asc("id")]
    )


def recent_results(
    encounters: DataFrame, records: DataFrame, n: int = 5, order: tuple[str, ...] = ("id",)
) -> DataFrame:
    """The first `n` result records of each patient, in chart order: encounters by id,
    and records by `order` within one.

    The chart's patient is the encounter's; the record's own patient column is not read.
    No encounter can give more than `n`, so its others are left out before the join.
    """
    within = [F.asc(c) for c in order]
    results = records.where(is_result(F.col("reference_range"))).drop("patient_id")
    owner = encounters.select(F.col("id").alias("encounter_id"), "patient_id")
    joined = first_rows(results, ["encounter_id"], within, n).join(owner, "encounter_id")
    return first_rows(joined, ["patient_id"], [F.asc("encounter_id"), *within], n)


def encounter_summary(encounters: DataFrame, records: DataFrame) -> DataFrame:
    """Per encounter: how many records, split into results and notes.

    Records are counted before the join, so an encounter with very many records
    reaches the join as one row.
    """
    counts = records.groupBy("encounter_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(is_result(F.col("reference_range"))).alias("n_results"),
    )
    joined = encounters.select(F.col("id").alias("encounter_id"), "patient_id").join(
        counts, "encounter_id", "left"
    )
    none = F.lit(0).cast("long")
    return joined.select(
        "encounter_id",
        "patient_id",
        F.coalesce("n_records", none).alias("n_records"),
        F.coalesce("n_results", none).alias("n_results"),
        F.coalesce(F.col("n_records") - F.col("n_results"), none).alias("n_notes"),
    )


def chart_summary(encounters: DataFrame, records: DataFrame) -> DataFrame:
    """Per patient with a chart: encounters, records, results, notes."""
    return (
        encounter_summary(encounters, records)
        .groupBy("patient_id")
        .agg(
            F.count(F.lit(1)).alias("n_encounters"),
            F.sum("n_records").alias("n_records"),
            F.sum("n_results").alias("n_results"),
            F.sum("n_notes").alias("n_notes"),
        )
    )


def bookable_slots(slots: DataFrame) -> DataFrame:
    return slots.where(status_not_in(F.col("status"), *CLOSED_SLOT))


def actionable_roi(roi_requests: DataFrame) -> DataFrame:
    return roi_requests.where(status_not_in(F.col("status"), *CLOSED_ROI))


def with_status_variant(df: DataFrame, column: str = "status") -> DataFrame:
    return df.withColumn("status_variant", status_variant(F.col(column)))
