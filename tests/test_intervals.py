"""Points and intervals beside all pairs, whatever their lengths."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from carelattice.functions import intervals
from carelattice.operators import compliance, latency
from tests.conftest import rows, ts


@pytest.mark.parametrize("cuts, part", [(None, 65_536), (5, 3)])
@pytest.mark.parametrize("points", [True, False])
def test_all_pairs(table, monkeypatch, cuts, part, points):
    monkeypatch.setattr(intervals, "PART_ROWS", part)
    rng = random.Random(part)
    moment = lambda: rng.choice([None, rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 30)])
    left = [(i, rng.choice(["a", "a", "a", "b", None]), moment(), moment()) for i in range(120)]
    right = [(i, rng.choice(["a", "a", "b", "c", None]), moment(), moment()) for i in range(60)]
    left += left[:5]
    before = lambda x, y: x is None or y is None or x <= y
    wanted = sorted(
        (p, i) for p, k, a, b in left for i, key, c, d in right
        if k is not None and k == key and before(c, d)
        and (a is not None and before(c, a) and before(a, d) if points else
             before(a, b) and before(a, d) and before(c, b))
    )
    held = table("p int, k string, a int, b int", *left)
    found = intervals.overlapping(
        held, table("i int, k string, c int, d int", *right), ["k"], ("a", None if points else "b"), ("c", "d"), cuts
    )
    assert rows(found, "_left_p", "_right_i") == wanted
    assert intervals.overlapping(held.limit(0), table("c int, d int", (1, 2)), [], ("a", None), ("c", "d")).count() == 0


def test_a_range_of_fifty_years(table):
    requests = table(
        "id int, patient_id int, date_range_start string, date_range_end string",
        (1, 5, "1970-01-01", "2020-01-01"), (2, 5, "1999-12-31", "1999-12-31"), (3, 6, None, None),
    )
    made = [(i, 5, ts("1969-12-30") + dt.timedelta(days=1_000 * i)) for i in range(30)]
    records = table("id int, patient_id int, created_at timestamp", *made, (99, 6, ts("1800-01-01")))
    found = compliance.minimum_necessary_packet(requests, records)
    wanted = [(1, i) for i, _, at in made if ts("1970-01-01") <= at < ts("2020-01-02")]
    assert rows(found, "request_id", "id") == [*wanted, (3, 99)]
    # The plan unfolds nothing but the numbers of the points that are found.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "month" not in plan.lower()


def test_an_outage_of_a_year(table):
    start = ts("2025-01-01")
    down = table(
        "incident_id int, start_at timestamp, end_at timestamp",
        (1, start, ts("2026-01-01")), (2, ts("2025-06-01"), ts("2025-06-01")), (3, ts("2025-03-01"), ts("2025-02-01")),
    )
    asked = [(i, start + dt.timedelta(hours=36 * i - 72), 3_600.0 * (i % 5)) for i in range(300)]
    asked += [(900, ts("2024-01-01"), 800 * 86_400.0), (901, ts("2025-05-31 23:00:00"), 3_600.0)]
    found = latency.outage_impact(down, table("request_id int, started_at timestamp, elapsed_s double", *asked))
    ends = {1: (start, ts("2026-01-01")), 2: (ts("2025-06-01"), ts("2025-06-01"))}
    wanted = sorted(
        (i, r) for i, (a, b) in ends.items() for r, s, d in asked
        if s <= b and s + dt.timedelta(seconds=d) >= a
    )
    assert rows(found, "incident_id", "request_id") == wanted


def test_blocks_of_rows_are_joined_without_a_broadcast(table, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_ROWS", 4, raising=False)
    monkeypatch.setattr(intervals, "PART_ROWS", 8)
    points = table("p int, a int", *[(i, i // 2) for i in range(200)])
    spans = [(1, -5, 300), (2, 3, 3), (3, 10, 47), (4, 99, 99), (5, 120, 130)]
    found = intervals.overlapping(points, table("i int, c int, d int", *spans), [], ("a", None), ("c", "d"), 3)
    assert rows(found, "_left_p", "_right_i") == sorted(
        (p, i) for p in range(200) for i, c, d in spans if c <= p // 2 <= d
    )
    # One row for each range of the order is all that is sent whole; a table of millions of starts is small on disk.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    fetched = plan[: plan.index("SortMergeJoin")]
    assert "BroadcastHashJoin" not in fetched


def test_records_of_patients_not_asked_for_are_dropped_before_they_are_joined(table):
    requests = table("id int, patient_id int, date_range_start string, date_range_end string", (1, 5, None, "2020-01-01"))
    encounters = table("encounter_id int, patient_id int", (1, 5), (2, 6))
    lines = table("encounter_id int, id int, created_at timestamp", (1, 10, ts("2019-01-01")), (2, 11, None))
    records = lines.join(encounters, "encounter_id")
    found = compliance.minimum_necessary_packet(requests, records)
    assert rows(found, "request_id", "id") == [(1, 10)]
    narrowed = compliance._of_asked(records, compliance._asked(requests))
    plan = narrowed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
