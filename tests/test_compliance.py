from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from carelattice.functions.text import mask_ssn
from carelattice.operators import compliance
from tests.conftest import rows, ts


def moment(text):
    return F.lit(text).cast("timestamp")


def test_accounting(table):
    disclosures = table(
        "id int, patient_id int, roi_request_id int, disclosed_to string, disclosed_at timestamp",
        (1, 5, 7, "a", ts("2026-01-01")), (2, 5, None, "b", ts("2020-06-01 00:00:01")),
        (3, 5, None, "c", ts("2020-05-31 23:59:59")), (4, 5, 99, "d", ts("2026-06-01")),
        (5, 5, 7, "e", ts("2026-06-02")),
    )
    requests = table("id int, requested_by string, purpose string", (7, "clerk", "legal"))
    found = compliance.accounting_of_disclosures(disclosures, requests, moment("2026-06-01"))
    assert rows(found, "id", "requested_by", "purpose", "authorization_missing") == [
        (1, "clerk", "legal", True), (2, None, None, True), (4, None, None, True),
    ]


@pytest.mark.parametrize("split_above", [3, 1_000])
def test_minimum_necessary(table, split_above):
    requests = table(
        "id int, patient_id int, date_range_start string, date_range_end string",
        (1, 5, "2026-01-02", "2026-01-03"), (2, 5, None, "2026-01-02"), (3, 5, "oops", None),
        (4, 9, None, None), (5, 5, "2026-01-03", "2026-01-01"), (6, 5, "2026-02-01", "2027-01-01"),
    )
    records = table(
        "id int, patient_id int, created_at timestamp",
        (1, 5, ts("2026-01-01 23:59:59")), (2, 5, ts("2026-01-02")), (3, 5, ts("2026-01-03 23:00:00")),
        (4, 6, ts("2026-01-02")),
    )
    packet = compliance.minimum_necessary_packet(requests, records)
    assert rows(packet, "request_id", "id") == [(1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
    excess = compliance.excess_release(requests, records, split_above)
    assert rows(excess, "request_id", "n_released", "n_in_range", "n_excess") == [
        (1, 3, 2, 1), (2, 3, 2, 1), (3, 3, 3, 0), (4, 0, 0, 0),
        (5, 3, 0, 3), (6, 3, 0, 3),
    ]


def test_access_report(table):
    audit = table(
        "actor string, message string, created_at timestamp, deleted_at timestamp",
        ("records-service", "GET /patients/1042/records 200", ts("2026-06-01"), None),
        ("records-service", "GET /patients/1043/records 200", ts("2026-06-01"), ts("2026-06-02")),
        ("records-service", "GET /patients/1044/records 200", ts("2026-03-02"), None),
        ("intake-service", 'POST /intake body={"name":"x"}', ts("2026-06-01"), None),
        ("records-service", "GET /patients/77 404", ts("2026-06-01"), None),
    )
    found = compliance.chart_access_report(audit, moment("2026-06-10"))
    assert rows(found, "patient_id", "actor_kind", "action") == [
        (77, "service", "GET /patients/77"), (1042, "service", "GET /patients/1042/records"),
    ]
    assert rows(compliance.parse_audit(audit), "status") == [(None,), (200,), (200,), (200,), (404,)]


@pytest.mark.parametrize("split_above", [50, 100_000])
def test_id_walks(table, split_above):
    rng = random.Random(1)
    reads, expected = [], []
    for principal in ("a", "b", "c"):
        previous, run = None, []
        for seq in range(200 if principal == "a" else 30):
            n = previous + 1 if previous is not None and rng.random() < 0.7 else rng.randint(1, 99)
            reads.append((principal, ts("2026-01-01") if seq < 9 else ts("2026-01-02"), seq, n))
            if previous is not None and n == previous + 1:
                run.append(n)
            else:
                expected.append((principal, run))
                run = [n]
            previous = n
        expected.append((principal, run))
    df = table("who string, at timestamp, seq int, n int", *reads)
    found = compliance.id_walk_detection(
        compliance.as_reads(df, "who", "at", "seq", "n"), 3, split_above
    )
    assert rows(found, "principal", "first_id", "last_id", "n_reads") == sorted(
        (p, r[0], r[-1], len(r)) for p, r in expected if len(r) >= 3
    )


def test_foreign_chart_requests(table):
    base = "https://portal.example.com/api/patients/"
    entries = table(
        "position int, url string, authorization string",
        (0, base + "1042/records", "Bearer <patient-1042-token>"),
        (1, base + "1043/records", "Bearer <patient-1042-token>"),
        (2, base + "1043/records", None), (3, "https://portal.example.com/", "Bearer <patient-1-token>"),
    )
    assert rows(compliance.foreign_chart_requests(entries), "position") == [(1,)]


def test_sensitive_text(table):
    text = "ssn 900-11-2222 tel 555-010-1111, a.b@example.com dob 1971-03-02; no 1900-11-22223"
    df = table("id int, note string, other string", (1, text, None), (2, "clean", "900-11-2222"))
    found = compliance.scan_phi(df, ["note", "other"], ["id"])
    assert rows(found, "id", "column", "kind", "found", "n_found") == [
        (1, "note", "dob", ["1971-03-02"], 1), (1, "note", "email", ["a.b@example.com"], 1),
        (1, "note", "phone", ["555-010-1111"], 1), (1, "note", "ssn", ["900-11-2222"], 1),
        (2, "other", "ssn", ["900-11-2222"], 1),
    ]
    masked = compliance.redact_phi(df, ["note", "other"])
    assert rows(masked, "id", "note", "other") == [
        (1, "ssn •••-••-2222 tel [phone], [email] dob [date]; no 1900-11-22223", None),
        (2, "clean", "•••-••-2222"),
    ]
    shown = table("ssn string", ("900-11-2222",), ("",), (None,)).select(mask_ssn(F.col("ssn")))
    assert rows(shown) == [(None,), (None,), ("•••-••-2222",)]


def test_breach_scale(spark, table):
    affected = spark.range(1_000).selectExpr(
        "if(id < 998, 1, 2) as incident_id", "if(id < 998, id div 2, id) as patient_id"
    )
    affected = affected.unionByName(table("incident_id int, patient_id long", (3, 1), (3, 1)))
    incidents = table(
        "incident_id int, discovered_at timestamp", *[(i, ts("2026-01-31 10:00:00")) for i in (1, 2, 3, 4)]
    )
    found = compliance.breach_scale(affected, incidents)
    assert [tuple(r)[0:1] + tuple(r)[2:4] + (str(r[4]),) for r in found.orderBy("incident_id").collect()] == [
        (1, 499, False, "2026-04-01"), (2, 2, False, "2026-04-01"), (3, 1, False, "2026-04-01"),
        (4, 0, False, "2026-04-01"),
    ]
    more = affected.unionByName(table("incident_id int, patient_id long", (1, 9_999)))
    assert compliance.breach_scale(more, incidents).where("notify_media").count() == 1


def test_sensitive_values_in_other_notations(table):
    text = "Call (310) 555-0147 or 310.555.0148, ssn 987654320, born 19520730 or 1952-07-30."
    masked = rows(compliance.redact_phi(table("id int, t string", (1, text)), ["t"]), "t")
    assert masked == [("Call [phone] or [phone], ssn •••-••-4320, born [date] or [date].",)]


def test_long_ids_stay_whole(table):
    lines = table(
        "id int, actor string, message string, created_at timestamp, deleted_at timestamp",
        (1, "svc", "GET /patients/9223372036854775807/records 200", ts("2025-01-01"), None),
        (2, "svc", "GET /patients/3000000000 200", ts("2025-01-01"), None),
    )
    at = F.lit("2025-01-02").cast("timestamp")
    assert rows(compliance.chart_access_report(lines, at), "patient_id") == [
        (3_000_000_000,), (9_223_372_036_854_775_807,),
    ]


def test_undated_records_belong_to_requests_without_a_range(table):
    asked = table(
        "id int, patient_id int, date_range_start string, date_range_end string",
        (1, 5, None, None), (2, 5, "2025-01-01", None),
    )
    held = table("id int, patient_id int, created_at timestamp", (8, 5, ts("2025-01-03")), (9, 5, None))
    packet = compliance.minimum_necessary_packet(asked, held)
    assert rows(packet, "request_id", "id") == [(1, 8), (1, 9), (2, 8)]
    excess = compliance.excess_release(asked, held)
    assert rows(excess, "request_id", "n_released", "n_in_range", "n_excess") == [(1, 2, 2, 0), (2, 2, 1, 1)]
