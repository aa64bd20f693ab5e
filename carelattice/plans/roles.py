"""The given tables in the roles of clinic tables.

Each function only renames and derives columns, so Catalyst reads what a query uses.
The `*_SQL` texts state the same roles for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.plans.registry import Tables


def patients(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("gender"),
        F.col("c_nationkey").alias("nation"),
    )


def encounters(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderpriority").alias("encounter_type"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("occurred_at"),
    )


RECORD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def records(t: Tables) -> DataFrame:
    """Line items; the id is the line number with part and supplier as tie-break."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("encounter_id"),
        F.struct(*RECORD_ORDER).alias("id"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("status"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("reference_range"),
        F.col("l_shipdate").alias("created_at"),
    )


def patient_records(t: Tables) -> DataFrame:
    """Records with their encounter's patient."""
    owner = encounters(t).select(F.col("id").alias("encounter_id"), "patient_id")
    return records(t).join(owner, "encounter_id")


def providers(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def slots(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.struct("l_orderkey", *RECORD_ORDER).alias("id"),
        F.col("l_suppkey").alias("provider_id"),
        F.col("l_shipdate").alias("start_at"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("booked").alias("status"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


K_SQL = "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)"

# purchase -> confirmed, error -> cancelled, signup -> completed, others by name;
# clicks have no scheduled time and views no status.
EVENT_STATUS_SQL = (
    "CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'cancelled'"
    " WHEN 'signup' THEN 'completed' WHEN 'view' THEN NULL ELSE event_type END"
)


def appointments(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("patient_id"),
        (F.dayofmonth("ts") * 100 + _k()).alias("slot_id"),
        F.when(kind == "purchase", "confirmed")
        .when(kind == "error", "cancelled")
        .when(kind == "signup", "completed")
        .when(kind == "click", "click")
        .alias("status"),
        F.when(kind != "click", F.col("ts")).alias("scheduled_for"),
        F.col("ts").alias("created_at"),
    )


APPOINTMENTS_SQL = f"""
    SELECT event_id AS id, user_id AS patient_id, day(ts) * 100 + {K_SQL} AS slot_id,
           {EVENT_STATUS_SQL} AS status,
           CASE WHEN event_type <> 'click' THEN ts END AS scheduled_for, ts AS created_at
    FROM events"""


def advisory_slots(t: Tables) -> DataFrame:
    """Slots as the events name them; every third is advised as booked."""
    ids = appointments(t).select(F.col("slot_id").alias("id")).distinct()
    return ids.withColumn("status", F.when(F.col("id") % 3 == 0, "booked").otherwise("open"))


def roi_requests(t: Tables) -> DataFrame:
    """Signups as release requests with a two-month range; status by k."""
    return t.events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("patient_id"),
        F.concat(F.lit("clerk"), _k() % 5).alias("requested_by"),
        F.concat(F.lit("recipient"), _k()).alias("recipient"),
        F.when(_k() % 4 == 0, F.lit(None)).otherwise(F.lit("1996-01-01")).alias("date_range_start"),
        F.lit("1996-03-01").alias("date_range_end"),
        F.lit("referral").alias("purpose"),
        F.when(_k() % 3 == 0, "denied")
        .when(_k() % 3 == 1, "fulfilled")
        .otherwise("pending")
        .alias("status"),
    )


ROI_SQL = f"""
    SELECT event_id AS id, user_id AS patient_id, 'clerk' || ({K_SQL} % 5) AS requested_by,
           'recipient' || {K_SQL} AS recipient,
           CASE WHEN {K_SQL} % 4 <> 0 THEN DATE '1996-01-01' END AS range_start,
           DATE '1996-03-01' AS range_end, 'referral' AS purpose,
           CASE {K_SQL} % 3 WHEN 0 THEN 'denied' WHEN 1 THEN 'fulfilled' ELSE 'pending' END
             AS status
    FROM events WHERE event_type = 'signup'"""


def disclosures(t: Tables) -> DataFrame:
    """Purchases as releases; odd ones name the event 1..3 before them as their request."""
    return t.events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("patient_id"),
        F.when(_k() % 2 == 1, F.col("event_id") - _k() % 3 - 1).alias("roi_request_id"),
        F.concat(F.lit("recipient"), _k()).alias("disclosed_to"),
        F.col("ts").alias("disclosed_at"),
    )


DISCLOSURES_SQL = f"""
    SELECT event_id AS id, user_id AS patient_id,
           CASE WHEN {K_SQL} % 2 = 1 THEN event_id - {K_SQL} % 3 - 1 END AS roi_request_id,
           'recipient' || {K_SQL} AS disclosed_to, ts AS disclosed_at
    FROM events WHERE event_type = 'purchase'"""


def coverages(t: Tables) -> DataFrame:
    """Customers as coverages; one segment is without member id, one with a blank one."""
    segment = F.col("c_mktsegment")
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_custkey").alias("patient_id"),
        F.when(segment == "BUILDING", F.lit(None))
        .when(segment == "MACHINERY", F.lit("  "))
        .otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
        .alias("member_id"),
        F.lit("unknown").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("verified_at"),
    )


COVERAGES_SQL = """
    SELECT c_custkey AS id, c_custkey AS patient_id,
           CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN ''
             ELSE CAST(c_custkey AS VARCHAR) END AS member_id
    FROM customer"""


def payer_responses(t: Tables) -> DataFrame:
    """Events as payer answers; error events are failed calls."""
    failed = F.col("event_type") == "error"
    return t.events.select(
        F.col("user_id").cast("string").alias("insurance_id"),
        F.when(~failed, 200 + 4 * _k()).cast("int").alias("status_code"),
        F.when(failed, "timeout").alias("error"),
        F.col("ts").alias("checked_at"),
        F.col("event_type").alias("payer"),
    )


RESPONSES_SQL = f"""
    SELECT CAST(user_id AS VARCHAR) AS insurance_id,
           CASE WHEN event_type <> 'error' THEN CAST(200 + 4 * {K_SQL} AS INTEGER) END
             AS raw_status,
           CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
           event_type <> 'error' AND 200 + 4 * {K_SQL} < 400 AS active,
           ts AS checked_at, event_type AS payer
    FROM events"""


def audit_logs(t: Tables) -> DataFrame:
    """Views as chart reads, other events as registrations; k = 0 is soft-deleted."""
    read = F.concat(F.lit("GET /patients/"), F.col("user_id"), F.lit("/records 200"))
    return t.events.select(
        F.col("event_id").alias("id"),
        F.lit("records-service").alias("actor"),
        F.when(F.col("event_type") == "view", read)
        .otherwise(F.concat(F.lit("POST /intake body="), F.col("props")))
        .alias("message"),
        F.col("ts").alias("created_at"),
        F.when(_k() == 0, F.col("ts")).alias("deleted_at"),
    )


def access_events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "ts", "event_id", _k().alias("k"))


def log_requests(t: Tables) -> DataFrame:
    """Events as timed requests."""
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("answered_at"),
        F.col("ts").alias("started_at"),
        F.col("value").alias("elapsed_s"),
    )
