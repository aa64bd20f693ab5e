"""The twelve clinic tables: columns, defaults, and the column lists results show."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "id": T.LongType(),
    "text": T.StringType(),
    "bool": T.BooleanType(),
    "ts": T.TimestampType(),
}


def _table(spec: str) -> T.StructType:
    """``"id id!, name text"`` -> StructType; ``!`` marks NOT NULL."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


# Table columns, in table order.
TABLES: dict[str, T.StructType] = {
    "users": _table(
        "id id!, username text!, password_hash text!, full_name text, role text!,"
        " is_active bool!, last_login_at ts, created_at ts!"
    ),
    "patients": _table(
        "id id!, mrn text, name text!, dob text, ssn text, gender text, address text,"
        " phone text, email text, notes text, created_via text, created_at ts!"
    ),
    "insurance_coverages": _table(
        "id id!, patient_id id!, payer_name text, member_id text, group_number text,"
        " plan_type text, status text, verified_at ts, created_at ts!"
    ),
    "providers": _table("id id!, name text!, specialty text, location text"),
    "slots": _table(
        "id id!, provider_id id, location text, start_at ts!, end_at ts, status text!"
    ),
    "appointments": _table(
        "id id!, patient_id id!, slot_id id!, provider text, reason text, location text,"
        " scheduled_for ts, status text!, created_at ts!"
    ),
    "encounters": _table(
        "id id!, patient_id id!, encounter_type text, provider text, reason text,"
        " location text, status text, summary text, allergies text, medications text,"
        " occurred_at ts!"
    ),
    "records": _table(
        "id id!, encounter_id id!, patient_id id!, kind text, title text, body text,"
        " status text, reference_range text, created_at ts!"
    ),
    "consents": _table("id id!, patient_id id!, kind text, signed_at ts!"),
    "audit_logs": _table("id id!, actor text, message text, created_at ts!, deleted_at ts"),
    "roi_requests": _table(
        "id id!, patient_id id!, requested_by text, recipient text, recipient_type text,"
        " purpose text, date_range_start text, date_range_end text, status text!,"
        " created_at ts!"
    ),
    "disclosures": _table(
        "id id!, patient_id id!, roi_request_id id, disclosed_to text, disclosed_at ts!"
    ),
}

# Literal column defaults. Time defaults take the caller's `as_of`.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "staff", "is_active": True},
    "insurance_coverages": {"status": "unknown"},
    "slots": {"status": "open"},
    "appointments": {"status": "confirmed"},
    "encounters": {"status": "finished"},
    "roi_requests": {"status": "pending"},
}

# Columns whose default is the current time.
TIME_DEFAULTS: dict[str, str] = {
    "users": "created_at",
    "patients": "created_at",
    "insurance_coverages": "created_at",
    "appointments": "created_at",
    "encounters": "occurred_at",
    "records": "created_at",
    "consents": "signed_at",
    "audit_logs": "created_at",
    "roi_requests": "created_at",
    "disclosures": "disclosed_at",
}

# Declared foreign keys, (child, column, parent).
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("insurance_coverages", "patient_id", "patients"),
    ("slots", "provider_id", "providers"),
    ("appointments", "patient_id", "patients"),
    ("encounters", "patient_id", "patients"),
    ("records", "encounter_id", "encounters"),
    ("records", "patient_id", "patients"),
    ("consents", "patient_id", "patients"),
    ("roi_requests", "patient_id", "patients"),
    ("disclosures", "patient_id", "patients"),
    ("disclosures", "roi_request_id", "roi_requests"),
]

# A key that the application relies on without declaring it.
UNDECLARED_KEYS: list[tuple[str, str, str]] = [("appointments", "slot_id", "slots")]

# The documented values of the open-string enum columns.
ENUM_DOMAINS: dict[tuple[str, str], list[str]] = {
    ("patients", "created_via"): ["self_service", "front_desk"],
    ("insurance_coverages", "plan_type"): ["PPO", "HMO", "Medicaid", "Medicare", "self_pay"],
    ("insurance_coverages", "status"): ["active", "inactive", "unknown"],
    ("slots", "status"): ["open", "booked"],
    ("encounters", "encounter_type"): ["office_visit", "lab", "imaging", "telehealth"],
    ("records", "kind"): ["lab_result", "note", "imaging", "immunization"],
    ("records", "status"): ["final", "preliminary", "normal", "abnormal"],
    ("consents", "kind"): ["npp_ack", "treatment_consent", "roi_consent"],
    ("roi_requests", "recipient_type"): ["self", "provider", "attorney", "payer"],
    ("roi_requests", "status"): ["pending", "fulfilled", "denied"],
}

# Columns each kind of result shows.
PATIENT_SUMMARY = ["id", "mrn", "name", "dob", "gender", "created_at"]
PATIENT_DETAIL = [
    "id", "mrn", "name", "dob", "ssn", "gender", "address", "phone", "email", "notes",
    "created_via", "created_at",
]
ENCOUNTER_OUT = [
    "id", "patient_id", "encounter_type", "provider", "reason", "location", "status",
    "summary", "allergies", "medications", "occurred_at",
]
RECORD_OUT = [
    "id", "encounter_id", "patient_id", "kind", "title", "body", "status", "reference_range",
]
RELEASED_RECORD = ["id", "encounter_id", "patient_id", "kind", "title", "body", "status"]
SEARCH_HIT = ["id", "patient_id", "kind", "title", "body"]
SLOT_OUT = ["id", "provider_id", "provider", "location", "start_at", "end_at", "status"]
APPOINTMENT_OUT = [
    "id", "patient_id", "slot_id", "provider", "reason", "location", "scheduled_for",
    "status", "created_at",
]

# Intake defaults.
DEFAULT_CREATED_VIA = "self_service"
DEFAULT_CONSENTS = ["npp_ack", "treatment_consent"]
