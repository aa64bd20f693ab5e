"""Write queries on the given tables: the rows each batch of requests would add or change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.operators import hl7, writes
from carelattice.plans import roles
from carelattice.plans.registry import Tables, query


def _payloads(t: Tables) -> DataFrame:
    """Customers as registration payloads: some without insurance or consents, some bad."""
    nation = F.col("c_nationkey")
    name = (
        F.when(nation == 24, F.lit("  "))
        .when(nation == 23, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")))
    )
    demographics = F.struct(name.alias("name"), F.col("c_mktsegment").alias("notes"))
    insurance = F.when(
        F.col("c_acctbal") > 0, F.struct(F.col("c_custkey").cast("string").alias("member_id"))
    )
    consents = F.when(nation % 2 == 0, F.array(F.lit("npp_ack"), F.lit("roi_consent"))).when(
        nation % 5 == 0, F.array().cast("array<string>")
    )
    document = F.to_json(
        F.struct(
            demographics.alias("demographics"),
            insurance.alias("insurance"),
            consents.alias("consents"),
        )
    )
    return t.customer.select(
        F.col("c_custkey").alias("payload_id"),
        F.when(nation == 22, F.concat(F.lit("x"), document)).otherwise(document).alias("payload"),
    )


_VALID_SQL = """
    SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal,
           (SELECT max(c_custkey) FROM customer)
             + row_number() OVER (ORDER BY c_custkey) AS patient_id
    FROM customer WHERE c_nationkey NOT IN (22, 23, 24)"""


@query("""
    SELECT c_custkey AS payload_id,
           CASE c_nationkey WHEN 22 THEN 'invalid_json' WHEN 23 THEN 'name_missing'
             ELSE 'name_blank' END AS reject_reason
    FROM customer WHERE c_nationkey IN (22, 23, 24)""")
def intake_rejected(t: Tables) -> DataFrame:
    return writes.validate_intake(_payloads(t))[1].select("payload_id", "reject_reason")


def _fanout(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    valid, _ = writes.validate_intake(_payloads(t))
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    signed = t.events.select(F.col("event_id").alias("id"))
    return writes.intake_fanout(
        valid, roles.patients(t), ["payload_id"], as_of, roles.coverages(t), signed
    )


@query(f"""
    SELECT patient_id AS id, c_name AS name, c_mktsegment AS notes, 'self_service' AS created_via,
           TIMESTAMP '2024-01-01' AS created_at
    FROM ({_VALID_SQL}) v""")
def intake_patients(t: Tables) -> DataFrame:
    return _fanout(t)[0].select("id", "name", "notes", "created_via", "created_at")


@query(f"""
    SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY patient_id) AS id,
           patient_id, CAST(c_custkey AS VARCHAR) AS member_id, 'unknown' AS status
    FROM ({_VALID_SQL}) v WHERE c_acctbal > 0""")
def intake_coverages(t: Tables) -> DataFrame:
    return _fanout(t)[1].select("id", "patient_id", "member_id", "status")


@query(f"""
    SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY patient_id, position) AS id,
           patient_id, kind FROM (
    SELECT patient_id, unnest(range(2)) AS position, unnest(CASE WHEN c_nationkey % 2 = 0 THEN ['npp_ack', 'roi_consent']
                                   WHEN c_nationkey % 5 = 0 THEN []
                                   ELSE ['npp_ack', 'treatment_consent'] END) AS kind
    FROM ({_VALID_SQL}) v) x WHERE kind IS NOT NULL""")
def intake_consents(t: Tables) -> DataFrame:
    return _fanout(t)[2].select("id", "patient_id", "kind")


def _bookings(t: Tables) -> DataFrame:
    """All events but signups ask for their slot."""
    return roles.appointments(t).where("status is null or status <> 'completed'").select(
        F.col("id").alias("request_id"),
        F.col("created_at").alias("requested_at"),
        "patient_id",
        "slot_id",
        F.lit(None).cast("string").alias("provider"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("location"),
        "scheduled_for",
    )


def _held(t: Tables) -> DataFrame:
    """Slots of signups at odd slot numbers are confirmed, the rest cancelled."""
    rows = roles.appointments(t).where("status = 'completed'")
    return rows.withColumn(
        "status", F.when(F.col("slot_id") % 2 == 1, "confirmed").otherwise("cancelled")
    )


_OUTCOMES_SQL = f"""
    WITH a AS ({roles.APPOINTMENTS_SQL}),
    held AS (SELECT DISTINCT slot_id FROM a WHERE status = 'completed' AND slot_id % 2 = 1)
    SELECT a.id AS request_id, a.patient_id, a.slot_id, a.created_at AS requested_at,
           CASE WHEN held.slot_id IS NULL AND row_number() OVER (
             PARTITION BY a.slot_id ORDER BY a.created_at, a.id) = 1
             THEN 'confirmed' ELSE 'slot_taken' END AS outcome
    FROM a LEFT JOIN held ON held.slot_id = a.slot_id
    WHERE a.status IS NULL OR a.status <> 'completed'"""


@query(f"SELECT request_id, patient_id, slot_id, outcome FROM ({_OUTCOMES_SQL}) x")
def resolve_bookings(t: Tables) -> DataFrame:
    outcomes = writes.resolve_bookings(_bookings(t), _held(t))
    return outcomes.select("request_id", "patient_id", "slot_id", "outcome")


@query(f"""
    SELECT (SELECT max(event_id) FROM events WHERE event_type = 'signup')
             + row_number() OVER (ORDER BY requested_at, request_id) AS id,
           patient_id, slot_id, 'confirmed' AS status
    FROM ({_OUTCOMES_SQL}) x WHERE outcome = 'confirmed'""")
def booked_appointments(t: Tables) -> DataFrame:
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    added = writes.booked_appointments(_bookings(t), _held(t), at)
    return added.select("id", "patient_id", "slot_id", "status")


@query(f"""
    SELECT event_id AS request_id,
           CASE WHEN user_id <= 0 THEN 'patient_id' WHEN {roles.K_SQL} <= 0 THEN 'slot_id'
                WHEN {roles.K_SQL} > 50 THEN 'provider' WHEN {roles.K_SQL} > 40 THEN 'reason' END
             AS reject_reason
    FROM events""")
def validate_booking(t: Tables) -> DataFrame:
    """Texts of 4k and 49k + 1 characters, so that larger k exceed the two limits."""
    k = F.get_json_object("props", "$.k").cast("int")
    requests = t.events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("patient_id"),
        k.alias("slot_id"),
        F.repeat(F.lit("é"), 4 * k).alias("provider"),
        F.repeat(F.lit("r"), 49 * k + 1).alias("reason"),
        F.lit(None).cast("string").alias("location"),
    )
    return writes.validate_booking(requests).select("request_id", "reject_reason")


@query(f"""
    SELECT a.id, CASE WHEN c.id IS NOT NULL THEN 'cancelled' ELSE a.status END AS status
    FROM ({roles.APPOINTMENTS_SQL}) a
    LEFT JOIN (SELECT DISTINCT o_custkey * 10 AS id FROM orders) c ON c.id = a.id""")
def apply_cancellations(t: Tables) -> DataFrame:
    ids = t.orders.select((F.col("o_custkey") * 10).alias("appointment_id"))
    return writes.apply_cancellations(ids, roles.appointments(t))[0].select("id", "status")


@query("""
    SELECT c.id AS appointment_id,
           CASE WHEN event_id IS NULL THEN 'not_found' ELSE 'cancelled' END AS outcome
    FROM (SELECT DISTINCT o_custkey * 10 AS id FROM orders) c
    LEFT JOIN events ON event_id = c.id""")
def cancellation_outcomes(t: Tables) -> DataFrame:
    ids = t.orders.select((F.col("o_custkey") * 10).alias("appointment_id"))
    return writes.apply_cancellations(ids, roles.appointments(t))[1]


def _roi_calls(t: Tables) -> tuple[DataFrame, DataFrame]:
    asked = roles.roi_requests(t).select(
        F.col("id").alias("call_id"),
        (F.col("patient_id") * 20).alias("patient_id"),
        "requested_by",
        F.when(F.col("status") == "denied", F.lit("")).otherwise(F.col("recipient"))
        .alias("recipient"),
        F.lit("attorney").alias("recipient_type"),
    )
    return writes.create_roi(asked, roles.patients(t), roles.roi_requests(t), ["call_id"])


_CREATE_ROI_SQL = f"""
    SELECT r.id AS call_id, r.patient_id * 20 AS patient_id,
           CASE WHEN r.patient_id <= 0 THEN 'patient_id' WHEN r.status = 'denied' THEN 'recipient'
                WHEN c_custkey IS NULL THEN 'patient_not_found' END AS reject_reason
    FROM ({roles.ROI_SQL}) r LEFT JOIN customer ON c_custkey = r.patient_id * 20"""


@query(f"""
    SELECT (SELECT max(event_id) FROM events WHERE event_type = 'signup')
             + row_number() OVER (ORDER BY call_id) AS id,
           call_id, patient_id, 'pending' AS status FROM ({_CREATE_ROI_SQL}) x
    WHERE reject_reason IS NULL""")
def create_roi(t: Tables) -> DataFrame:
    return _roi_calls(t)[0].select("id", "call_id", "patient_id", "status")


@query(f"""
    SELECT call_id, patient_id, reject_reason FROM ({_CREATE_ROI_SQL}) x
    WHERE reject_reason IS NOT NULL""")
def create_roi_rejected(t: Tables) -> DataFrame:
    return _roi_calls(t)[1].select("call_id", "patient_id", "reject_reason")


def _fulfil(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    calls = t.orders.select(
        F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("request_id")
    )
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    return writes.fulfill_roi(calls, roles.roi_requests(t), at, roles.disclosures(t), ["call_id"])


@query(f"""
    SELECT id, CASE WHEN id IN (SELECT o_custkey FROM orders) THEN 'fulfilled' ELSE status END
             AS status
    FROM ({roles.ROI_SQL}) r""")
def fulfill_roi(t: Tables) -> DataFrame:
    return _fulfil(t)[0].select("id", "status")


@query(f"""
    SELECT (SELECT max(event_id) FROM events WHERE event_type = 'purchase')
             + row_number() OVER (ORDER BY o_orderkey) AS id,
           o_orderkey AS call_id, patient_id, r.id AS roi_request_id, recipient AS disclosed_to
    FROM orders JOIN ({roles.ROI_SQL}) r ON r.id = o_custkey""")
def fulfill_disclosures(t: Tables) -> DataFrame:
    return _fulfil(t)[1].select("id", "call_id", "patient_id", "roi_request_id", "disclosed_to")


def _messages(t: Tables) -> DataFrame:
    """Orders as messages: visits of status F are cut short, P repeats a short patient line."""
    status = F.col("o_orderstatus")
    dob = F.date_format("o_orderdate", "yyyyMMdd")
    header = F.concat(F.lit("MSH|^~\\&|H|H|P|C|20240101||ADT^A01|"), F.col("o_orderkey"))
    person = F.concat(
        F.lit(" PID|1||"), F.col("o_custkey"), F.lit("||Doe^"), F.col("o_orderpriority"),
        F.lit("||"), dob, F.lit("|F "),
    )
    again = F.when(status == "P", F.concat(F.lit("\rPID|1||M"), F.col("o_custkey"))).otherwise("")
    visit = F.when(status == "F", F.lit("PV1|1|O|WARD")).otherwise(
        F.concat(F.lit("PV1|1|O|WARD||||"), F.col("o_orderkey"), F.lit("^Roe"))
    )
    allergy = F.concat(F.lit("AL1|1|DA|p^"), F.col("o_orderpriority"))
    drug = F.concat(F.lit("RXA|0|1|x||drug"), F.col("o_custkey"))
    text = F.concat(
        header, F.lit("\r\n"), person, again, F.lit("\n\n"), visit, F.lit("\x0b"), allergy,
        F.lit("\u2028"), drug,
    )
    return t.orders.select(F.col("o_orderkey").alias("message_id"), text.alias("message"))


@query("""
    SELECT o_orderkey AS message_id,
           CASE WHEN o_orderstatus = 'P' THEN 'M' ELSE '' END || o_custkey AS mrn,
           'Doe^' || o_orderpriority AS name, strftime(o_orderdate, '%Y%m%d') AS dob,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderkey || '^Roe' END AS provider,
           CASE WHEN o_orderstatus <> 'F' THEN 'WARD' END AS location,
           CAST(0 AS INTEGER) AS n_items
    FROM orders""")
def parse_hl7(t: Tables) -> DataFrame:
    return hl7.parse_hl7(_messages(t)).select(
        "message_id", "mrn", "name", "dob", "provider", "location",
        (F.size("allergies") + F.size("medications")).alias("n_items"),
    )


@query("""
    SELECT o_orderkey AS message_id, o_orderpriority AS allergy, 'drug' || o_custkey AS medication
    FROM orders""")
def hl7_clinical_items(t: Tables) -> DataFrame:
    found = hl7.hl7_clinical_items(_messages(t))
    return found.select(
        "message_id",
        F.array_join("allergies", ",").alias("allergy"),
        F.array_join("medications", ",").alias("medication"),
    )


@query("""
    SELECT segment, count(*) AS n_segments FROM (
      SELECT unnest(CASE WHEN o_orderstatus = 'F' THEN ['MSH', 'PV1', 'AL1', 'RXA']
                         ELSE ['MSH', 'AL1', 'RXA'] END) AS segment FROM orders) x
    GROUP BY segment""")
def hl7_unmapped_segments(t: Tables) -> DataFrame:
    return hl7.hl7_unmapped_segments(_messages(t))


@query("""
    SELECT segment, position, count(*) AS n, CAST(sum(n_fields) AS BIGINT) AS n_fields FROM (
      SELECT unnest(CASE WHEN o_orderstatus = 'P' THEN ['MSH', 'PID', 'PID', 'PV1', 'AL1', 'RXA']
                         ELSE ['MSH', 'PID', 'PV1', 'AL1', 'RXA'] END) AS segment,
             unnest(CASE WHEN o_orderstatus = 'P' THEN [0, 1, 2, 3, 4, 5]
                         ELSE [0, 1, 2, 3, 4] END) AS position,
             unnest(CASE o_orderstatus WHEN 'P' THEN [10, 9, 4, 8, 4, 6]
                         WHEN 'F' THEN [10, 9, 4, 4, 6] ELSE [10, 9, 8, 4, 6] END) AS n_fields
      FROM orders) x
    GROUP BY segment, position""")
def hl7_segments(t: Tables) -> DataFrame:
    return hl7.hl7_segments(_messages(t)).groupBy("segment", "position").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("fields")).alias("n_fields")
    )


@query("""
    SELECT doc_id AS message_id,
           CASE WHEN strlen(text) > 32768 THEN 'too_large' END AS reject_reason
    FROM documents
    UNION ALL SELECT -1 - doc_id, 'empty' FROM documents""")
def validate_hl7(t: Tables) -> DataFrame:
    """Each document eight times over as one message, and a blank message beside it."""
    full = t.documents.select(
        F.col("doc_id").alias("message_id"), F.repeat("text", F.lit(8)).alias("message")
    )
    blank = t.documents.select(
        (-1 - F.col("doc_id")).alias("message_id"), F.lit(" \n\u3000").alias("message")
    )
    return hl7.validate_hl7(full.unionByName(blank)).select("message_id", "reject_reason")
