"""Synthetic clinic tables of any size, made by Spark jobs.

Every value is a hash of (seed, column, row id), so it depends neither on the
partitioning nor on the order of rows. Counts and mixes follow the demo clinic this
library was modelled on; the people are invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelattice.schemas import DEFAULTS, TABLES

FIRST_NAMES = ["Ada", "Bruno", "Celia", "Dario", "Esme", "Farid", "Greta", "Hugo", "Ines", "Jonas"]
LAST_NAMES = ["Abbot", "Brandt", "Castellan", "Duarte", "Eklund", "Farrow", "Grimaldi", "Holloway"]
STREETS = ["Alder Way", "Beacon St", "Cobble Ln", "Dune Rd", "Ember Ct"]
PAYERS = ["Northern Mutual", "Lakeside Health", "Summit Plan", "Public Aid", "Senior Aid", None]
def _weighted(*pairs: tuple[int, int]) -> list[int]:
    """(value, weight) pairs as a list to draw from."""
    return [value for value, weight in pairs for _ in range(weight)]


# Mixes of the demo clinic.
PLAN_TYPES = ["PPO", "PPO", "HMO", "Medicaid", "Medicare", "self_pay"]
COVERAGE_STATUSES = ["active", "active", "active", "inactive", "unknown"]
ENCOUNTER_TYPES = ["office_visit", "office_visit", "lab", "imaging", "telehealth"]
ENCOUNTERS_PER_PATIENT = _weighted((0, 1), (1, 4), (2, 4), (3, 2), (4, 1))
RECORDS_PER_ENCOUNTER = _weighted((1, 6), (2, 2), (3, 1))
APPOINTMENTS_PER_PATIENT = [0, 0, 1, 1, 1, 2]
ALLERGIES = ["", "", "", "penicillin", "sulfa", "latex", "peanuts", "none known"]
RECORD_KINDS = ["note", "note", "lab_result", "imaging", "immunization"]
LAB_STATUSES = ["normal", "normal", "abnormal", "preliminary"]
APPOINTMENT_STATUSES = ["confirmed", "confirmed", "confirmed", "cancelled", "completed"]
SLOT_STATUSES = ["open", "open", "open", "booked"]
ROI_STATUSES = ["pending", "pending", "fulfilled", "denied"]
N_PROVIDERS = 8

# Invented recipients.
RECIPIENTS = [("Tern Point Rehab", "provider"), ("Larch and Moss", "attorney"), ("Patient", "self")]
# One patient in so many has two further charts: a misspelt one, and one with the
# initial only and day and month exchanged.
DUPLICATE_EVERY = 50


class _Draws:
    def __init__(self, seed: int):
        self.seed = seed

    def number(self, name: str, low: int, high: int, *keys: str) -> Column:
        """A whole number in [low, high]."""
        drawn = F.xxhash64(F.lit(self.seed), F.lit(name), *keys)
        return F.pmod(drawn, F.lit(high - low + 1)) + low

    def one_of(self, name: str, values: list, *keys: str) -> Column:
        place = self.number(name, 0, len(values) - 1, *keys).cast("int")
        return F.get(F.array(*[F.lit(v) for v in values]), place)

    def chance(self, name: str, percent: int, *keys: str) -> Column:
        return self.number(name, 1, 100, *keys) <= percent

    def days_before(self, name: str, as_of: Column, low: int, high: int, *keys: str) -> Column:
        return as_of - F.make_dt_interval(days=self.number(name, low, high, *keys).cast("int"))


def _repeat(df: DataFrame, count: Column) -> DataFrame:
    """Each row `count` times, numbered from 0 in `k`."""
    numbers = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1))
    return df.select("*", F.explode(numbers).alias("k"))


def generate_clinic(
    spark: SparkSession, n_patients: int, seed: int = 7, as_of: str = "2026-06-20"
) -> dict[str, DataFrame]:
    """The twelve tables, and `log_lines` with registrations in the old log format.

    Ids are 64-bit. Patients are 1..n; the two further charts of patient p have the
    ids n+2p and n+2p+1. Every slot below 1/20 of the slots is also double-booked.
    """
    draw = _Draws(seed)
    now = F.lit(as_of).cast("timestamp")
    base = spark.range(1, n_patients + 1)
    first = draw.one_of("first", FIRST_NAMES, "id")
    last = draw.one_of("last", LAST_NAMES, "id")
    people = base.select(
        "id",
        F.concat(F.lit("M"), draw.number("mrn", 1_000, 9_999, "id")).alias("mrn"),
        first.alias("_first"),
        last.alias("_last"),
        draw.number("year", 1940, 2007, "id").alias("_year"),
        draw.number("month", 1, 12, "id").alias("_month"),
        draw.number("day", 1, 28, "id").alias("_day"),
        F.concat_ws(
            "-",
            draw.number("ssn1", 200, 699, "id"),
            draw.number("ssn2", 10, 99, "id"),
            draw.number("ssn3", 1_000, 9_999, "id"),
        ).alias("ssn"),
        draw.one_of("gender", ["F", "M", "M", "F", "X"], "id").alias("gender"),
        F.concat_ws(
            " ", draw.number("house", 10, 9_999, "id"), draw.one_of("street", STREETS, "id")
        ).alias("address"),
        F.format_string("555-010-%04d", draw.number("phone", 0, 9_999, "id")).alias("phone"),
        F.concat(
            F.lower(first), F.lit("."), F.lower(last), draw.number("mail", 1, 99, "id"),
            F.lit("@example.com"),
        ).alias("email"),
        F.lit("").alias("notes"),
        draw.one_of("via", ["self_service", "front_desk", "front_desk"], "id").alias("created_via"),
        draw.days_before("created", now, 5, 1_500, "id").alias("created_at"),
    )

    def dob(month: str, day: str) -> Column:
        return F.format_string("%04d-%02d-%02d", "_year", month, day)

    drawn = ["mrn", "ssn", "gender", "address", "phone", "email", "notes", "created_via", "created_at"]
    plain = people.select(
        "id", F.concat_ws(" ", "_first", "_last").alias("name"),
        dob("_month", "_day").alias("dob"), *drawn,
    )
    repeated = people.where(F.col("id") % DUPLICATE_EVERY == 0)
    misspelt = repeated.select(
        (n_patients + 2 * F.col("id")).alias("id"),
        F.concat(F.col("_first"), F.lit(" "), F.col("_last"), F.lit("e")).alias("name"),
        dob("_month", "_day").alias("dob"), *drawn,
    )
    initialled = repeated.where(F.col("_day") <= 12).select(
        (n_patients + 2 * F.col("id") + 1).alias("id"),
        F.concat(F.substring("_first", 1, 1), F.lit(". "), F.col("_last")).alias("name"),
        dob("_day", "_month").alias("dob"), *drawn,
    )
    patients = plain.unionByName(misspelt).unionByName(initialled)
    ids = patients.select(F.col("id").alias("patient_id"))

    payer = draw.number("payer", 0, len(PAYERS) - 1, "patient_id")
    status = draw.one_of("coverage", COVERAGE_STATUSES, "patient_id")
    coverages = ids.select(
        F.col("patient_id").alias("id"),
        "patient_id",
        F.get(F.array(*[F.lit(p) for p in PAYERS]), payer.cast("int")).alias("payer_name"),
        F.when(payer < len(PAYERS) - 1, F.concat(
            F.lit("MB"), draw.number("member", 1_000, 9_999_999, "patient_id"))
        ).alias("member_id"),
        F.get(F.array(*[F.lit(p) for p in PLAN_TYPES]), payer.cast("int")).alias("plan_type"),
        F.when(payer < len(PAYERS) - 1, status).otherwise(F.lit("unknown")).alias("status"),
        F.when((payer < len(PAYERS) - 1) & (status != "unknown"), now).alias("verified_at"),
        now.alias("created_at"),
    )
    providers = spark.range(1, N_PROVIDERS + 1).select(
        "id",
        F.concat(F.lit("Dr. "), draw.one_of("provider", LAST_NAMES, "id")).alias("name"),
        draw.one_of("site", ["Main", "North", "South"], "id").alias("location"),
    )
    n_slots = max(n_patients // 2, 1)
    slots = spark.range(1, n_slots + 1).select(
        "id",
        draw.number("slot_provider", 1, N_PROVIDERS, "id").alias("provider_id"),
        (now + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("start_at"),
        (now + F.make_dt_interval(hours=F.col("id").cast("int"), mins=F.lit(30))).alias("end_at"),
        draw.one_of("slot_status", SLOT_STATUSES, "id").alias("status"),
    )
    booked = _repeat(ids, draw.one_of("n_appointments", APPOINTMENTS_PER_PATIENT, "patient_id")).select(
        (F.col("patient_id") * 4 + F.col("k")).alias("id"),
        "patient_id",
        draw.number("slot", 1, n_slots, "patient_id", "k").alias("slot_id"),
        (now + F.make_dt_interval(days=draw.number("ahead", 1, 30, "patient_id", "k").cast("int")))
        .alias("scheduled_for"),
        draw.one_of("appointment", APPOINTMENT_STATUSES, "patient_id", "k").alias("status"),
        draw.days_before("booked", now, 0, 20, "patient_id", "k").alias("created_at"),
    )
    planted = _repeat(slots.where(F.col("id") <= F.lit(max(n_slots // 20, 1))), F.lit(2)).select(
        (4 * (3 * n_patients + 2) + F.col("id") * 2 + F.col("k")).alias("id"),
        draw.number("planted", 1, n_patients, "id", "k").alias("patient_id"),
        F.col("id").alias("slot_id"),
        F.col("start_at").alias("scheduled_for"),
        F.lit("confirmed").alias("status"),
        (now + F.make_dt_interval(secs=F.col("k") * F.lit(0.399).cast("decimal(18,6)"))).alias(
            "created_at"
        ),
    )
    encounters = _repeat(ids, draw.one_of("n_encounters", ENCOUNTERS_PER_PATIENT, "patient_id")).select(
        (F.col("patient_id") * 8 + F.col("k")).alias("id"),
        "patient_id",
        draw.one_of("type", ENCOUNTER_TYPES, "patient_id", "k").alias("encounter_type"),
        F.lit("Follow-up").alias("reason"),
        draw.one_of("allergy", ALLERGIES, "patient_id", "k").alias("allergies"),
        draw.one_of("medication", ["", "", "metformin", "albuterol"], "patient_id", "k").alias(
            "medications"
        ),
        draw.days_before("occurred", now, 1, 1_200, "patient_id", "k").alias("occurred_at"),
    )
    kind = draw.one_of("kind", RECORD_KINDS, "encounter_id", "k")
    records = (
        _repeat(
            encounters.select(F.col("id").alias("encounter_id"), "patient_id", "occurred_at"),
            draw.one_of("n_records", RECORDS_PER_ENCOUNTER, "encounter_id"),
        )
        .withColumn("kind", kind)
        .select(
            (F.col("encounter_id") * 4 + F.col("k")).alias("id"),
            "encounter_id",
            "patient_id",
            "kind",
            F.initcap(F.translate("kind", "_", " ")).alias("title"),
            F.concat(F.lit("Seen for "), F.col("kind"), F.lit(".")).alias("body"),
            F.when(F.col("kind") == "lab_result", draw.one_of("lab", LAB_STATUSES, "encounter_id", "k"))
            .otherwise(F.lit("final")).alias("status"),
            F.when(F.col("kind") == "lab_result", F.lit("4.0-11.0")).alias("reference_range"),
            F.col("occurred_at").alias("created_at"),
        )
    )
    signed = ids.select(
        "patient_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(draw.chance("npp", 85, "patient_id"), F.lit("npp_ack")),
                    F.when(draw.chance("treatment", 70, "patient_id"), F.lit("treatment_consent")),
                )
            )
        ).alias("kind"),
    )
    consents = signed.select(
        (F.col("patient_id") * 2 + (F.col("kind") == "npp_ack").cast("int")).alias("id"),
        "patient_id", "kind", now.alias("signed_at"),
    )
    recipient = draw.number("recipient", 0, len(RECIPIENTS) - 1, "id").cast("int")
    asked = base.where(draw.number("roi", 1, 16, "id") == 1)
    roi_requests = asked.select(
        "id",
        F.col("id").alias("patient_id"),
        F.lit("clerk").alias("requested_by"),
        F.get(F.array(*[F.lit(r) for r, _ in RECIPIENTS]), recipient).alias("recipient"),
        F.get(F.array(*[F.lit(t) for _, t in RECIPIENTS]), recipient).alias("recipient_type"),
        F.lit("Referral").alias("purpose"),
        F.lit("2024-01-01").alias("date_range_start"),
        F.lit("2026-06-01").alias("date_range_end"),
        draw.one_of("roi_status", ROI_STATUSES, "id").alias("status"),
        draw.days_before("asked", now, 0, 50, "id").alias("created_at"),
    )
    disclosures = base.where(draw.number("disclosed", 1, 32, "id") == 1).select(
        "id",
        F.col("id").alias("patient_id"),
        F.lit(RECIPIENTS[0][0]).alias("disclosed_to"),
        draw.days_before("released", now, 0, 45, "id").alias("disclosed_at"),
    )
    audit_logs = base.where(draw.number("read", 1, 12, "id") == 1).select(
        "id",
        F.lit("records-service").alias("actor"),
        F.concat(F.lit("GET /patients/"), F.col("id"), F.lit("/records 200")).alias("message"),
        now.alias("created_at"),
    )
    users = spark.range(1, 13).select(
        "id",
        F.concat(F.lit("user"), F.col("id")).alias("username"),
        F.lit("!").alias("password_hash"),
        now.alias("created_at"),
    )
    tables = {
        "users": users, "patients": patients, "insurance_coverages": coverages,
        "providers": providers, "slots": slots,
        "appointments": booked.unionByName(planted), "encounters": encounters,
        "records": records, "consents": consents, "audit_logs": audit_logs,
        "roi_requests": roi_requests, "disclosures": disclosures,
    }
    made = {name: _complete(df, name) for name, df in tables.items()}
    made["log_lines"] = _log_lines(plain, draw)
    return made


def _complete(df: DataFrame, table: str) -> DataFrame:
    """All columns of the table, defaults filled in, ids kept at 64 bits."""
    columns = []
    for field in TABLES[table].fields:
        default = F.lit(DEFAULTS.get(table, {}).get(field.name))
        value = F.col(field.name) if field.name in df.columns else default
        wide = T.LongType() if field.dataType == T.IntegerType() else field.dataType
        columns.append(value.cast(wide).alias(field.name))
    return df.select(*columns)


def _log_lines(patients: DataFrame, draw: _Draws) -> DataFrame:
    """Two log lines per patient: the request with the whole body, and the answer."""
    stamp = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    body = F.to_json(F.struct("name", "dob", "ssn", "address", "phone"))
    hundredths = draw.number("elapsed", 400, 500, "id")
    answer = F.date_format(F.col("created_at") + F.expr("interval 5 seconds"), "yyyy-MM-dd HH:mm:ss")
    return patients.select(
        F.concat(F.lit("node-"), F.pmod("id", F.lit(16))).alias("source"),
        F.explode(
            F.array(
                F.concat(stamp, F.lit(" INFO  POST /intake body="), body),
                F.concat(
                    answer, F.lit(" INFO  POST /intake 201 patient_id="), F.col("id"),
                    F.format_string(" elapsed=%.2fs", hundredths / F.lit(100.0)),
                ),
            )
        ).alias("value"),
    )
