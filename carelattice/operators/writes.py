"""Write operators: batches of requests against the clinic tables.

Each takes the request table and the current tables and returns the rows to add or
the changed rows; sinks write them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelattice.functions.ordered import dense_numbers, first_rows
from carelattice.functions.text import strip
from carelattice.operators.charts import PAGE_ROWS, disclosure_packet
from carelattice.schemas import DEFAULT_CONSENTS, DEFAULT_CREATED_VIA
from carelattice.session import cut_lineage
from carelattice.sources.sinks import current_state

# Intake payload fields.
DEMOGRAPHICS = [
    "name", "dob", "ssn", "gender", "address", "phone", "email", "notes", "created_via",
]
INSURANCE = ["payer_name", "member_id", "group_number", "plan_type"]
# Booking text limits, in characters.
MAX_NAME_CHARS = 200
MAX_REASON_CHARS = 2_000


def next_id(table: DataFrame) -> Column:
    """The largest id in use, as a scalar subquery; 0 for an empty table."""
    return F.coalesce(table.agg(F.max("id").cast("long")).scalar(), F.lit(0).cast("long"))


def with_new_ids(rows: DataFrame, table: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Give `rows` the next ids of `table`, dense and in `order`."""
    numbered = dense_numbers(rows, order, "_number")
    return numbered.withColumn(name, F.col("_number") + next_id(table)).drop("_number")


def parse_intake(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payload text -> typed columns and `reject_reason` (null when valid).

    The checks follow the request model: demographics with a non-blank name are
    required, present text fields must be JSON strings, only `created_via` and
    `consents` have defaults, and those apply only where the key is absent.
    """
    doc = payloads.withColumn("_doc", F.try_parse_json(column))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_doc", path, "variant"))

    def value(path: str) -> Column:
        return F.try_variant_get("_doc", path, "string")

    def optional_text(path: str) -> Column:
        return F.coalesce(kind(path).isin("STRING", "VOID"), F.lit(True))

    insurance_kind = kind("$.insurance")
    consents_kind = kind("$.consents")
    bad_text = F.lit(False)
    for field in DEMOGRAPHICS[1:-1]:
        bad_text = bad_text | ~optional_text(f"$.demographics.{field}")
    for field in INSURANCE:
        bad_text = bad_text | ~optional_text(f"$.insurance.{field}")
    via_kind = kind("$.demographics.created_via")
    name = strip(value("$.demographics.name"))
    reason = (
        F.when(F.col("_doc").isNull(), F.lit("invalid_json"))
        .when(~F.coalesce(kind("$.demographics").startswith("OBJECT"), F.lit(False)),
              F.lit("demographics_missing"))
        .when(F.coalesce(kind("$.demographics.name") != "STRING", F.lit(True)),
              F.lit("name_missing"))
        .when(name == "", F.lit("name_blank"))
        .when(F.coalesce(via_kind != "STRING", F.lit(False)) | bad_text, F.lit("field_type"))
        .when(~F.coalesce(insurance_kind.startswith("OBJECT") | (insurance_kind == "VOID"),
                          F.lit(True)), F.lit("insurance_type"))
        .when(~F.coalesce(consents_kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
              | _has_null_item("$.consents"), F.lit("consents_type"))
    )
    demographics = F.struct(
        name.alias("name"),
        *[value(f"$.demographics.{f}").alias(f) for f in DEMOGRAPHICS[1:-1]],
        F.coalesce(value("$.demographics.created_via"), F.lit(DEFAULT_CREATED_VIA)).alias(
            "created_via"
        ),
    )
    insurance = F.when(
        insurance_kind.startswith("OBJECT"),
        F.struct(*[value(f"$.insurance.{f}").alias(f) for f in INSURANCE]),
    )
    consents = F.when(consents_kind.isNull(), F.array(*map(F.lit, DEFAULT_CONSENTS))).otherwise(
        F.try_variant_get("_doc", "$.consents", "array<string>")
    )
    return doc.select(
        *payloads.columns,
        reason.alias("reject_reason"),
        demographics.alias("demographics"),
        insurance.alias("insurance"),
        consents.alias("consents"),
    )


def _has_null_item(path: str) -> Column:
    items = F.try_variant_get("_doc", path, "array<string>")
    return F.coalesce(F.exists(items, lambda item: item.isNull()), F.lit(False))


def validate_intake(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) payloads; rejected rows keep their input and a reason.

    The parsed payloads are written once, so that later steps do not parse again.
    """
    parsed = cut_lineage(parse_intake(payloads, column), "intake")
    valid = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = parsed.where(F.col("reject_reason").isNotNull()).select(
        *payloads.columns, "reject_reason"
    )
    return valid, rejected


def intake_fanout(
    valid: DataFrame, patients: DataFrame, order: list[str], as_of: Column,
    coverages: DataFrame | None = None, consents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid payloads -> new patients, coverages and consents.

    Every payload opens a new chart: nobody is looked up. A coverage row appears only
    with insurance, and one consent row per listed kind, repeats kept. With the current
    `coverages` and `consents` tables given, their new rows get the next ids too.

    The numbered payloads are written once: all outputs name one patient alike, even where
    `order` leaves ties.
    """
    arrived = cut_lineage(with_new_ids(valid, patients, order, "patient_id"), "arrived")
    new_patients = arrived.select(
        F.col("patient_id").alias("id"),
        F.lit(None).cast("string").alias("mrn"),
        "demographics.*",
        as_of.alias("created_at"),
    )
    new_coverages = arrived.where(F.col("insurance").isNotNull()).select(
        "patient_id",
        "insurance.*",
        F.lit("unknown").alias("status"),
        F.lit(None).cast("timestamp").alias("verified_at"),
        as_of.alias("created_at"),
    )
    new_consents = arrived.select(
        "patient_id", F.posexplode("consents").alias("position", "kind"), as_of.alias("signed_at")
    )
    if coverages is not None:
        new_coverages = with_new_ids(new_coverages, coverages, ["patient_id"])
    if consents is not None:
        new_consents = with_new_ids(new_consents, consents, ["patient_id", "position"])
    return new_patients, new_coverages, new_consents


def validate_booking(requests: DataFrame) -> DataFrame:
    """Booking requests with `reject_reason`, null when the request is well formed."""
    def too_long(column: str, limit: int) -> Column:
        return F.coalesce(F.length(column) > limit, F.lit(False))

    def not_positive(column: str) -> Column:
        return F.coalesce(F.col(column) <= 0, F.lit(True))

    return requests.withColumn(
        "reject_reason",
        F.when(not_positive("patient_id"), F.lit("patient_id"))
        .when(not_positive("slot_id"), F.lit("slot_id"))
        .when(too_long("provider", MAX_NAME_CHARS), F.lit("provider"))
        .when(too_long("reason", MAX_REASON_CHARS), F.lit("reason"))
        .when(too_long("location", MAX_NAME_CHARS), F.lit("location")),
    )


def _confirmed_slots(appointments: DataFrame) -> DataFrame:
    return appointments.where(F.col("status") == "confirmed").select("slot_id").distinct()


def winning_requests(requests: DataFrame, appointments: DataFrame) -> DataFrame:
    """The earliest request of each slot that no confirmed appointment holds.

    Requests shrink to one per slot before they meet the appointments, and the
    appointments to distinct slots, so a slot everybody asks for stays one row.
    """
    first = first_rows(requests, ["slot_id"], [F.asc("requested_at"), F.asc("request_id")])
    return first.join(_confirmed_slots(appointments), "slot_id", "left_anti")


def resolve_bookings(requests: DataFrame, appointments: DataFrame) -> DataFrame:
    """Each request with its outcome: `confirmed` for the winner of a free slot, else
    `slot_taken`. Neither the slot's own status nor its existence matters.

    A request id is decided once, at its earliest row; its later rows are `repeated`.
    """
    again = Window.partitionBy("request_id").orderBy("requested_at", "slot_id")
    placed = requests.withColumn("_place", F.row_number().over(again))
    asked = placed.where(F.col("_place") == 1).drop("_place")
    won = winning_requests(asked, appointments).select(
        "request_id", F.lit(1).alias("_place"), F.lit("confirmed").alias("_won")
    )
    outcome = F.when(F.col("_place") > 1, "repeated").otherwise(F.coalesce("_won", F.lit("slot_taken")))
    return (
        placed.join(won, ["request_id", "_place"], "left")
        .withColumn("outcome", outcome)
        .select(*requests.columns, "outcome")
    )


def booked_appointments(
    requests: DataFrame, appointments: DataFrame, created_at: Column
) -> DataFrame:
    """The appointment rows that the winning requests add."""
    won = winning_requests(requests, appointments)
    return with_new_ids(won, appointments, ["requested_at", "request_id"]).select(
        "id", "patient_id", "slot_id", "provider", "reason", "location", "scheduled_for",
        F.lit("confirmed").alias("status"), created_at.alias("created_at"),
    )


def _status_changes(table: DataFrame, ids: DataFrame, status: str, changed_at: Column) -> DataFrame:
    """(id, status, changed_at) for each known id whose status is another one now."""
    other = ~F.col("status").eqNullSafe(F.lit(status))
    return (
        table.where(other).select("id").join(ids.select("id").distinct(), "id", "left_semi")
        .select("id", F.lit(status).alias("status"), changed_at.alias("changed_at"))
    )


def cancellation_changes(
    cancellations: DataFrame, appointments: DataFrame, changed_at: Column
) -> DataFrame:
    """The status changes that a batch of cancellations makes, for `sinks.append_status_changes`:
    only rows that change, whatever the size of the table."""
    asked = cancellations.select(F.col("appointment_id").alias("id"))
    return _status_changes(appointments, asked, "cancelled", changed_at)


def apply_cancellations(
    cancellations: DataFrame, appointments: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(appointments after cancelling, outcome of each cancelled id).

    Any status turns into `cancelled`; an unknown id is `not_found`. The first is the table read with
    `cancellation_changes` merged in; whoever keeps the changes writes those alone.
    """
    at = F.lit(None).cast("timestamp")
    after = current_state(appointments, cancellation_changes(cancellations, appointments, at))
    asked = cancellations.select(F.col("appointment_id").alias("id")).distinct()
    known = appointments.select("id", F.lit("cancelled").alias("_known"))
    outcomes = asked.join(known, "id", "left").select(
        F.col("id").alias("appointment_id"),
        F.coalesce("_known", F.lit("not_found")).alias("outcome"),
    )
    return after, outcomes


def create_roi(
    requests: DataFrame, patients: DataFrame, roi_requests: DataFrame | None = None,
    order: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) release requests; accepted ones are `pending`.

    With the current `roi_requests` table given, accepted ones get its next ids in `order`.
    """
    def missing(column: str) -> Column:
        return F.coalesce(F.col(column) == "", F.lit(True))

    checked = requests.withColumn(
        "reject_reason",
        F.when(F.coalesce(F.col("patient_id") <= 0, F.lit(True)), F.lit("patient_id"))
        .when(missing("requested_by"), F.lit("requested_by"))
        .when(missing("recipient"), F.lit("recipient"))
        .when(missing("recipient_type"), F.lit("recipient_type")),
    )
    known = patients.select(F.col("id").alias("patient_id"), F.lit(True).alias("_known"))
    formed = checked.where(F.col("reject_reason").isNull()).join(known, "patient_id", "left")
    accepted = (
        formed.where(F.col("_known").isNotNull())
        .drop("_known", "reject_reason")
        .withColumn("status", F.lit("pending"))
    )
    unknown = (
        formed.where(F.col("_known").isNull())
        .drop("_known")
        .withColumn("reject_reason", F.lit("patient_not_found"))
    )
    rejected = checked.where(F.col("reject_reason").isNotNull()).unionByName(unknown)
    if roi_requests is not None:
        accepted = with_new_ids(accepted, roi_requests, order or ["patient_id"])
    return accepted, rejected


def fulfilment_changes(calls: DataFrame, roi_requests: DataFrame, changed_at: Column) -> DataFrame:
    """The status changes that a batch of fulfilment calls makes, for `sinks.append_status_changes`."""
    asked = calls.select(F.col("request_id").alias("id"))
    return _status_changes(roi_requests, asked, "fulfilled", changed_at)


def fulfil_packets(
    calls: DataFrame, roi_requests: DataFrame, records: DataFrame, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """(request_id, patient_id, page, records): what each called request releases, its patient's whole
    record set whatever range was asked for. A patient without records is answered with an empty page;
    a request called repeatedly is answered once, and unknown ones are not."""
    asked = cut_lineage(
        roi_requests.select(F.col("id").alias("request_id"), "patient_id")
        .join(calls.select("request_id").distinct(), "request_id", "left_semi"),
        "called-requests",
    )
    packets = disclosure_packet(records, asked, page_rows)
    return asked.join(packets, "patient_id").select("request_id", "patient_id", "page", "records")


def fulfill_roi(
    calls: DataFrame, roi_requests: DataFrame, disclosed_at: Column,
    disclosures: DataFrame | None = None, order: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests after fulfilment, disclosures to add, calls that were not found).

    Each call adds a disclosure, repeated calls too, and the request becomes
    `fulfilled` whatever it was, denied included; `fulfilment_changes` has these changes alone, and
    `fulfil_packets` what is released. With the
    current `disclosures` table given, the new ones get its next ids in `order`.
    """
    after = current_state(roi_requests, fulfilment_changes(calls, roi_requests, disclosed_at))
    target = roi_requests.select(
        F.col("id").alias("request_id"), "patient_id", F.col("recipient").alias("disclosed_to")
    )
    added = calls.join(target, "request_id").select(
        *[c for c in calls.columns if c != "request_id"],
        "patient_id",
        F.col("request_id").alias("roi_request_id"),
        "disclosed_to",
        disclosed_at.alias("disclosed_at"),
    )
    unknown = calls.join(target, "request_id", "left_anti")
    if disclosures is not None:
        added = with_new_ids(added, disclosures, order or ["roi_request_id"])
    return after, added, unknown
