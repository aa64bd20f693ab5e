from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from carelattice.operators import writes
from tests.conftest import rows, ts

def now():
    return F.lit("2026-06-01").cast("timestamp")


def payloads(table, *documents):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    return table("payload_id int, payload string", *enumerate(texts, 1))


@pytest.mark.parametrize(
    "document, reason",
    [
        ({"demographics": {"name": "A"}}, None),
        ({"demographics": {"name": "A", "extra": 1}, "more": []}, None),
        ({"demographics": {"name": "   "}}, "name_blank"),
        ({"demographics": {"name": "　\x1f"}}, "name_blank"),
        ({"demographics": {"name": ""}}, "name_blank"),
        ({"demographics": {"name": 5}}, "name_missing"),
        ({"demographics": {"name": None}}, "name_missing"),
        ({"demographics": {"dob": "x"}}, "name_missing"),
        ({"insurance": {}}, "demographics_missing"),
        ({"demographics": []}, "demographics_missing"),
        ({"demographics": {"name": "A", "dob": 1971}}, "field_type"),
        ({"demographics": {"name": "A", "dob": None}}, None),
        ({"demographics": {"name": "A", "created_via": None}}, "field_type"),
        ({"demographics": {"name": "A"}, "insurance": "none"}, "insurance_type"),
        ({"demographics": {"name": "A"}, "insurance": {"plan_type": 1}}, "field_type"),
        ({"demographics": {"name": "A"}, "consents": None}, "consents_type"),
        ({"demographics": {"name": "A"}, "consents": ["x", 1]}, "consents_type"),
        ({"demographics": {"name": "A"}, "consents": ["x", None]}, "consents_type"),
        ({"demographics": {"name": "A"}, "consents": []}, None),
        ({"demographics": {"first_name": "A", "last_name": "B"}, "consents": {"privacy": True}},
         "name_missing"),
        ("{not json", "invalid_json"),
        ("", "invalid_json"),
    ],
)
def test_intake_validation(table, document, reason):
    parsed = writes.parse_intake(payloads(table, document)).first()
    assert parsed.reject_reason == reason


def test_intake_fanout(table):
    arriving = payloads(
        table,
        {"demographics": {"name": " Ann Lee "}},
        {"demographics": {"name": ""}},
        {
            "demographics": {"name": "Bo", "created_via": "front_desk", "email": "b@x.org"},
            "insurance": {"payer_name": "P", "member_id": "M1"},
            "consents": ["npp_ack", "npp_ack"],
        },
        {"demographics": {"name": "Ann Lee"}, "insurance": {}, "consents": []},
        {"demographics": {"name": "Di"}, "insurance": None},
    )
    valid, rejected = writes.validate_intake(arriving)
    assert rows(rejected, "payload_id", "reject_reason") == [(2, "name_blank")]
    existing = table("id int", (41,), (7,))
    patients, coverages, consents = writes.intake_fanout(valid, existing, ["payload_id"], now())
    assert rows(patients, "id", "name", "created_via", "mrn", "email") == [
        (42, "Ann Lee", "self_service", None, None), (43, "Bo", "front_desk", None, "b@x.org"),
        (44, "Ann Lee", "self_service", None, None), (45, "Di", "self_service", None, None),
    ]
    assert rows(coverages, "patient_id", "payer_name", "member_id", "status") == [
        (43, "P", "M1", "unknown"), (44, None, None, "unknown"),
    ]
    assert rows(consents, "patient_id", "kind") == [
        (42, "npp_ack"), (42, "treatment_consent"), (43, "npp_ack"), (43, "npp_ack"),
        (45, "npp_ack"), (45, "treatment_consent"),
    ]
    first = writes.intake_fanout(valid, existing.where("id < 0"), ["payload_id"], now())[0]
    assert rows(first, "id") == [(1,), (2,), (3,), (4,)]


BOOKING = (
    "request_id string, requested_at timestamp, patient_id int, slot_id int, provider string,"
    " reason string, location string, scheduled_for timestamp"
)


def booking(request_id, at, slot, **more):
    row = {"patient_id": 1, "provider": None, "reason": None, "location": None, **more}
    return (
        request_id, ts(at), row["patient_id"], slot, row["provider"], row["reason"],
        row["location"], None,
    )


def test_booking_validation(table):
    asked = table(
        BOOKING,
        booking("a", "2026-01-01", 1, provider="é" * 200, reason="r" * 2000, location="l" * 200),
        booking("b", "2026-01-01", 1, provider="é" * 201),
        booking("c", "2026-01-01", 1, reason="r" * 2001),
        booking("d", "2026-01-01", 1, location="l" * 201),
        booking("e", "2026-01-01", 0),
        booking("f", "2026-01-01", 1, patient_id=-1),
        booking("g", "2026-01-01", 1, patient_id=None),
    )
    assert [r[1] for r in rows(writes.validate_booking(asked), "request_id", "reject_reason")] == [
        None, "provider", "reason", "location", "slot_id", "patient_id", "patient_id",
    ]


def test_bookings(table):
    held = table(
        "id int, slot_id int, status string",
        (5, 10, "confirmed"), (6, 11, "cancelled"), (7, 12, "Confirmed"),
    )
    asked = table(
        BOOKING,
        booking("a", "2026-01-02", 10), booking("b", "2026-01-02", 11),
        booking("c", "2026-01-01", 11), booking("d", "2026-01-01", 11),
        booking("e", "2026-01-01", 12), booking("f", "2026-01-01", 999),
    )
    outcomes = writes.resolve_bookings(asked, held)
    assert rows(outcomes, "request_id", "outcome") == [
        ("a", "slot_taken"), ("b", "slot_taken"), ("c", "confirmed"), ("d", "slot_taken"),
        ("e", "confirmed"), ("f", "confirmed"),
    ]
    added = writes.booked_appointments(asked, held, now())
    assert rows(added, "id", "slot_id", "status") == [
        (8, 11, "confirmed"), (9, 12, "confirmed"), (10, 999, "confirmed"),
    ]


def test_cancelling_frees_the_slot(table):
    held = table("id int, slot_id int, status string", (5, 10, "confirmed"), (6, 11, "completed"))
    asked = table("appointment_id int", (5,), (5,), (6,), (77,))
    after, outcomes = writes.apply_cancellations(asked, held)
    assert rows(after) == [(5, 10, "cancelled"), (6, 11, "cancelled")]
    assert rows(outcomes) == [(5, "cancelled"), (6, "cancelled"), (77, "not_found")]
    again = writes.resolve_bookings(table(BOOKING, booking("a", "2026-01-02", 10)), after)
    assert rows(again, "outcome") == [("confirmed",)]


def test_create_roi(table):
    asked = table(
        "patient_id int, requested_by string, recipient string, recipient_type string",
        (1, "c", "r", "self"), (0, "c", "r", "self"), (1, "", "r", "self"), (1, "c", None, "self"),
        (1, "c", "r", ""), (9, "c", "r", "court"),
    )
    accepted, rejected = writes.create_roi(asked, table("id int", (1,)))
    assert rows(accepted, "patient_id", "status") == [(1, "pending")]
    assert sorted(r.reject_reason for r in rejected.collect()) == [
        "patient_id", "patient_not_found", "recipient", "recipient_type", "requested_by",
    ]


def test_fulfill_roi(table):
    requests = table(
        "id int, patient_id int, recipient string, status string",
        (1, 5, "a", "denied"), (2, 6, "b", "pending"), (3, 6, "c", "fulfilled"),
    )
    calls = table("call_id int, request_id int", (1, 1), (2, 3), (3, 3), (4, 50))
    after, disclosures, unknown = writes.fulfill_roi(calls, requests, now())
    assert rows(after, "id", "status") == [(1, "fulfilled"), (2, "pending"), (3, "fulfilled")]
    assert rows(disclosures, "call_id", "patient_id", "roi_request_id", "disclosed_to") == [
        (1, 5, 1, "a"), (2, 6, 3, "c"), (3, 6, 3, "c"),
    ]
    assert rows(unknown, "call_id", "request_id") == [(4, 50)]


def test_a_repeated_request_is_decided_once(table):
    asked = table(
        "request_id int, requested_at timestamp, patient_id int, slot_id int",
        (1, ts("2025-01-01 10:00:00"), 5, 8), (1, ts("2025-01-01 10:05:00"), 5, 8),
        (2, ts("2025-01-01 10:01:00"), 6, 8),
    )
    none_held = table("id int, slot_id int, status string")
    found = rows(writes.resolve_bookings(asked, none_held), "request_id", "requested_at", "outcome")
    assert [(r[0], r[2]) for r in found] == [(1, "confirmed"), (1, "repeated"), (2, "slot_taken")]


def test_created_rows_get_ids(table, spark):
    payloads = table(
        "payload_id int, payload string",
        (1, '{"demographics": {"name": "Ife"}, "insurance": {"member_id": "m"}}'),
        (2, '{"demographics": {"name": "Eva"}, "consents": ["npp_ack"]}'),
    )
    valid, _ = writes.validate_intake(payloads)
    used = table("id long", (40,))
    people, coverages, consents = writes.intake_fanout(
        valid, used, ["payload_id"], F.lit("2025-01-01").cast("timestamp"), used, used
    )
    assert rows(people, "id", "name") == [(41, "Ife"), (42, "Eva")]
    assert rows(coverages, "id", "patient_id") == [(41, 41)]
    assert rows(consents, "id", "patient_id") == [(41, 41), (42, 41), (43, 42)]
