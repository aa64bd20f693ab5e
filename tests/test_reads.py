from __future__ import annotations

import pytest

from carelattice.functions.text import STATUS_VARIANTS
from carelattice.operators import charts, eligibility, reads, search
from carelattice.sources import sinks
from tests.conftest import rows, ts


@pytest.fixture(scope="module")
def patients(table):
    names = ["Ana Lima", "BANA Core", "100% Sure", "under_score", "back\\slash", "Zed"]
    return table("id int, name string, ssn string", *[(i, n, "x") for i, n in enumerate(names, 1)])


@pytest.mark.parametrize(
    "q, ids",
    [
        ("ana", [1, 2]), (None, [1, 2, 3, 4, 5, 6]), ("", [1, 2, 3, 4, 5, 6]),
        ("a_a", [1, 2]), ("%", [1, 2, 3, 4, 5, 6]), ("0\\%", [3]), ("r\\_s", [4]),
        ("\\zed", [6]), ("k\\\\s", [5]), ("z%d", [6]),
    ],
)
def test_patient_search(patients, q, ids):
    assert [r[0] for r in reads.patient_search(patients, q).collect()] == ids
    assert reads.patient_search_total(patients, q).first()[0] == len(ids)


def test_patient_page(patients):
    page = reads.patient_search(patients, "", limit=2, offset=1)
    assert page.columns == ["id", "name"]
    assert [r.id for r in page.collect()] == [2, 3]
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            reads.patient_search(patients, **bad)


def test_patient_lookup(patients, table):
    found = reads.patient_lookup(patients, table("id int", (1,), (1,), (99,)))
    assert rows(found, "id", "name", "found") == [(1, "Ana Lima", True), (99, None, False)]


@pytest.fixture(scope="module")
def chart(table):
    encounters = table(
        "id int, patient_id int, status string", (12, 1, "a"), (11, 1, "b"), (13, 2, "c")
    )
    records = table(
        "id int, encounter_id int, patient_id int, title string, reference_range string",
        (3, 11, 1, "x", "1-2"), (1, 12, 9, "y", ""), (2, 12, 1, "z", None), (4, 12, 1, "w", "0"),
        (5, 99, 1, "orphan", "1"),
    )
    return encounters, records


@pytest.mark.parametrize("page_rows", [1_000, 3])
def test_patient_chart(chart, table, page_rows):
    ids = table("patient_id int", (1,), (2,), (2,), (77,))
    found = charts.patient_chart(*chart, ids, page_rows=page_rows, split_above=2)
    flat = {}
    for row in found.orderBy("patient_id", "page").collect():
        blocks = flat.setdefault(row.patient_id, [])
        for e in row.encounters:
            records = [r.id for r in e.records]
            if blocks and blocks[-1][0] == e.encounter.id:
                blocks[-1][1].extend(records)
            else:
                blocks.append((e.encounter.id, records))
            assert len(records) <= page_rows
    assert flat == {1: [(11, [3]), (12, [1, 2, 4])], 2: [(13, [])], 77: []}
    assert found.count() == (3 if page_rows == 1_000 else 4)


def test_encounter_summary(chart):
    assert rows(reads.encounter_summary(*chart)) == [(11, 1, 1, 1, 0), (12, 1, 3, 1, 2), (13, 2, 0, 0, 0)]
    assert rows(reads.chart_summary(*chart)) == [(1, 2, 4, 2, 2), (2, 1, 0, 0, 0)]


def test_recent_results(chart):
    assert rows(reads.recent_results(*chart, n=1), "patient_id", "id") == [(1, 3)]
    assert rows(reads.recent_results(*chart), "patient_id", "id") == [(1, 3), (1, 4)]


@pytest.mark.parametrize("page_rows", [1_000, 2])
def test_disclosure_packet(chart, table, page_rows):
    ids = table("patient_id int", (1,), (5,))
    found = charts.disclosure_packet(chart[1], ids, page_rows=page_rows)
    packets = {}
    for row in found.orderBy("patient_id", "page").collect():
        packets.setdefault(row.patient_id, []).extend(r.id for r in row.records)
        assert len(row.records) <= page_rows
    assert packets == {1: [2, 3, 4, 5], 5: []}
    assert "reference_range" not in found.schema["records"].dataType.elementType.names


@pytest.mark.parametrize("page_rows", [1_000, 2])
def test_charts_read_each_table_once(chart, table, counted, page_rows):
    (encounters, e), (records, r), (ids, i) = map(counted, (*chart, table("patient_id int", (1,), (77,))))
    found = charts.patient_chart(encounters, records, ids, page_rows=page_rows)
    assert {row.patient_id for row in found.collect()} == {1, 77}
    assert (e.value, r.value, i.value) == (3, 5, 2)
    packets = charts.disclosure_packet(records, ids, page_rows=page_rows)
    assert sum(len(row.records) for row in packets.collect()) == 4
    assert (r.value, i.value) == (10, 4)


def test_bucketed_charts_join_in_place(spark, chart, table):
    encounters, records = chart
    kept = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "-1")
    try:
        held = sinks.save_bucketed(encounters, "bucketed_encounters", "id", 4)
        noted = sinks.save_bucketed(records, "bucketed_records", "encounter_id", 4)
        found = charts.chart_rows(held, noted)
        plan = found._jdf.queryExecution().executedPlan().toString()
        matched = plan[: plan.index("LeftAnti")] if "LeftAnti" in plan else plan
        assert "SortMergeJoin [encounter_id" in matched and "Exchange" not in matched
        assert rows(found, "patient_id", "encounter_id", "record.id") == rows(
            charts.chart_rows(encounters, records), "patient_id", "encounter_id", "record.id"
        )
        ids = table("patient_id int", (1,), (2,))
        assert rows(charts.patient_chart(held, noted, ids)) == rows(charts.patient_chart(*chart, ids))
    finally:
        spark.conf.set(kept, before)
        spark.sql("drop table if exists bucketed_encounters")
        spark.sql("drop table if exists bucketed_records")


def test_slots(table):
    slots = table(
        "id int, provider_id int, start_at timestamp, status string",
        (1, 5, ts("2026-01-02"), "open"), (2, None, ts("2026-01-01"), "open"),
        (3, 6, ts("2026-01-01"), "Open"), (4, 5, ts("2026-01-01"), "booked"),
        (5, 7, ts("2026-01-01"), "unavailable"), (6, 8, ts("2026-01-01"), "CANCELED"),
    )
    providers = table("id int, name string", (5, "Dr. A"))
    found = reads.open_slots(slots, providers)
    assert [(r.id, r.provider) for r in found.collect()] == [(2, None), (1, "Dr. A")]
    assert [r.id for r in reads.open_slots(slots, providers, provider_id=5).collect()] == [1]
    with pytest.raises(ValueError):
        reads.open_slots(slots, providers, limit=201)
    odd = slots.unionByName(table("id int, status string", (9, None)), allowMissingColumns=True)
    assert rows(reads.bookable_slots(odd), "id") == [(1,), (2,), (3,), (9,)]


def test_appointments(table):
    made = table(
        "id int, patient_id int, status string, scheduled_for timestamp, created_at timestamp",
        (1, 1, "confirmed", ts("2026-05-02"), ts("2026-01-01")),
        (2, 1, "Cancelled", ts("2026-05-01"), ts("2026-01-03")),
        (3, 1, None, ts("2026-05-01"), ts("2026-01-03")),
        (4, 2, "completed", None, ts("2026-01-01")),
        (5, 3, "confirmed", None, ts("2026-01-01")),
        (6, 3, "confirmed", ts("2020-01-01"), ts("2026-01-01")),
    )
    assert rows(reads.next_appointment(made), "patient_id", "id") == [(1, 3), (3, 5)]
    listed = reads.appointments_for(made, table("patient_id int", (1,), (1,)))
    assert rows(listed, "place", "id") == [(1, 3), (2, 2), (3, 1)]


def test_roi_lists(table):
    asked = table(
        "id int, patient_id int, status string", (1, 5, "Denied"), (2, 5, None), (3, 6, "pending")
    )
    assert [r.id for r in reads.roi_requests_list(asked).collect()] == [3, 2, 1]
    assert [r.id for r in reads.roi_requests_list(asked, 5).collect()] == [2, 1]
    with pytest.raises(ValueError):
        reads.roi_requests_list(asked, 0)
    assert rows(reads.actionable_roi(asked), "id") == [(2,), (3,)]


def test_status_variants(table):
    known = [(s, v) for v, group in STATUS_VARIANTS.items() for s in group]
    assert len(known) == 24
    extra = [(" Confirmed ", "ok"), ("", "neutral"), (None, "neutral"), ("odd", "neutral")]
    df = table("status string, expected string", *known, *extra)
    assert reads.with_status_variant(df).where("status_variant <> expected").count() == 0


QUERIES = ["ana", "%", "a_a", "", "100\\%", "é", "___", "zz", "a%na", "\\q", "Straße", "a" * 80,
           "the Old port was", "n old PORT, w", " old ", "e old%port w", "Fee, fie; foe", "old  port"]
BODIES = ["Banana", "ananas 100%", "É clair", "ab", None, "", "quay", "STRASSE straße", "a" * 100, "zz",
          "The old port was closed", "an old port, was", "behold portals", "coffee, fie; foeman", "The OLD  port"]


def test_record_search_many_equals_single_searches(table):
    records = table("id int, body string", *enumerate(BODIES))
    queries = table("query_id int, q string", *enumerate(QUERIES))
    expected = [
        (i, r.id)
        for i, q in enumerate(QUERIES) if q
        for r in search.record_search(records, q).collect()
    ]
    assert rows(search.record_search_many(records, queries), "query_id", "id") == sorted(expected)
    with pytest.raises(ValueError):
        search.record_search(records, "")


def test_record_search_many_in_several_passes(table, monkeypatch):
    records = table("id int, body string", *enumerate(BODIES))
    queries = table("query_id int, q string", *enumerate(QUERIES))
    whole = rows(search.record_search_many(records, queries), "query_id", "id")
    monkeypatch.setattr(search, "QUERIES_PER_PASS", 4)
    assert rows(search.record_search_many(records, queries), "query_id", "id") == whole
    none = search.record_search_many(records, queries.where("q = 'never'"))
    assert none.count() == 0


def test_eligibility(table):
    coverages = table(
        "id int, member_id string, status string, verified_at timestamp",
        (1, " A1 ", "unknown", None), (2, "B2", "active", ts("2026-01-01")), (3, " ", "unknown", None),
        (4, None, "unknown", None), (5, "C3", "unknown", None), (6, "D4", "active", None),
    )
    responses = table(
        "insurance_id string, status_code int, error string, checked_at timestamp, payer string",
        ("A1", 200, None, ts("2026-02-01"), "p"), ("A1", 399, None, ts("2026-02-02"), "p"),
        ("B2", 404, None, ts("2026-02-01"), "p"), ("C3", None, "timed out", ts("2026-02-01"), "p"),
        (" ", 200, None, ts("2026-02-01"), "p"),
    )
    assert eligibility.check_responses(responses).count() == 4
    found = eligibility.eligibility_outcome(coverages, responses)
    assert rows(found, "id", "outcome", "active", "raw_status", "error") == [
        (1, "checked", True, 399, None),
        (2, "checked", False, 404, None), (3, "rejected", None, None, None),
        (5, "checked", False, None, "timed out"), (6, "no_response", None, None, None),
    ]
    after = eligibility.refresh_coverage(coverages, responses)
    assert rows(after, "id", "status", "verified_at") == [
        (1, "active", ts("2026-02-02")), (2, "inactive", ts("2026-02-01")), (3, "unknown", None),
        (4, "unknown", None), (5, "unknown", ts("2026-02-01")), (6, "active", None),
    ]
