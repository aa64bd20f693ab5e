from __future__ import annotations

import random

import numpy as np
import pytest

from carelattice.operators import latency
from carelattice.sources.readers import parse_app_log
from tests.conftest import rows, ts

LINES = [
    "2025-11-03 20:40:10 INFO  scheduler woke up, queue empty",
    "2025-11-03 20:41:30 INFO  GET /healthz 200 1.5ms",
    '2025-11-03 21:05:20 INFO  POST /intake body={"name":"Ima","note":"x } 404 elapsed=7s"}',
    "2025-11-03 21:05:23 INFO  POST /intake 201 patient_id=5000000017 elapsed=2.75s",
    '2025-11-03 21:20:00 INFO  POST /appointments body={"slot_id":31} 201 elapsed=1.2s',
    "2025-11-03 21:30:45 WARN  payer lookup took long elapsed=6.5s",
    '2025-11-03 21:40:02,125 INFO [intake-service] POST /intake body={"demographics":{"name":"Oz"}}',
    "2025-11-03 21:40:05,625 INFO [intake-service] POST /intake 201 patient_id=12 elapsed=3.25s",
    "2025-11-03 21:50:00 INFO  POST /intake 201 patient_id=13 elapsed=5.00s",
    "  at line 3 of nothing",
]


@pytest.fixture(scope="module")
def log(table):
    return parse_app_log(table("source string, value string", *[("f", line) for line in LINES]))


def test_log_lines(log):
    found = [
        (r.level, r.service, r.method, r.path, r.status, r.elapsed_s, r.patient_id)
        for r in log.collect()
    ]
    service = "intake-service"
    assert found == [
        ("INFO", None, None, None, None, None, None),
        ("INFO", None, "GET", "/healthz", 200, 0.0015, None),
        ("INFO", None, "POST", "/intake", None, None, None),
        ("INFO", None, "POST", "/intake", 201, 2.75, 5_000_000_017),
        ("INFO", None, "POST", "/appointments", 201, 1.2, None),
        ("WARN", None, None, None, None, 6.5, None),
        ("INFO", service, "POST", "/intake", None, None, None),
        ("INFO", service, "POST", "/intake", 201, 3.25, 12),
        ("INFO", None, "POST", "/intake", 201, 5.0, 13),
        (None, None, None, None, None, None, None),
    ]
    assert log.where("body like '{%}'").count() == 3
    assert log.where("ts = timestamp '2025-11-03 21:40:05.625'").count() == 1
    assert log.where("ts is null").count() == 1


@pytest.mark.parametrize("split_above", [2, 1_000])
def test_intake_pairs_and_windows(log, split_above):
    paired = latency.pair_intake(log, split_above)
    found = [(r[0], "Ima" in (r[1] or ""), r[2]) for r in rows(paired, "patient_id", "request_body", "started_at")]
    assert found == [
        (12, False, ts("2025-11-03 21:40:02.375")), (13, False, ts("2025-11-03 21:49:55")),
        (5_000_000_017, True, ts("2025-11-03 21:05:20.250")),
    ]
    assert paired.where("request_body is null").count() == 1
    windows = latency.latency_windows(paired, "1 hour", slow_seconds=4.9)
    (start, n, p50, p95, top, slow), = rows(windows)
    assert (start, n, top, slow) == (ts("2025-11-03 21:00:00"), 3, 5.0, False)
    assert p50 == pytest.approx(3.25) and p95 == pytest.approx(3.25 + 0.9 * 1.75)


@pytest.mark.parametrize("split_above", [3, 1_000])
def test_interleaved_requests_are_answered_in_order(table, split_above):
    rng = random.Random(3)
    made, wanted = [], []
    for source in "ab":
        open_, second = [], 0
        for n in range(60):
            second += rng.randint(1, 3)
            at = f"2025-11-03 21:{second // 60:02d}:{second % 60:02d}"
            if rng.random() < 0.5:
                open_.append(n)
                made.append((source, f'{at} INFO  POST /intake body={{"n":{n}}}'))
            elif rng.random() < 0.2:
                open_[:1] = []
                made.append((source, f"{at} INFO  POST /intake 422"))
            else:
                wanted.append((source, n, f'{{"n":{open_.pop(0)}}}' if open_ else None))
                made.append((source, f"{at} INFO  POST /intake 201 patient_id={n} elapsed=1.0s"))
    log = parse_app_log(table("source string, value string", *made))
    found = latency.pair_intake(log, split_above)
    assert rows(found, "source", "patient_id", "request_body") == sorted(wanted, key=lambda r: r[:2])
    assert {b is None for *_, b in wanted} == {True, False}


@pytest.mark.parametrize("split_above", [30, 10_000])
def test_exact_quantiles(table, split_above):
    rng = random.Random(2)
    values = {
        k: [round(rng.expovariate(1), 2) for _ in range(n)] for k, n in (("a", 400), ("b", 1), ("c", 2), ("d", 37))
    }
    df = table("k string, v double", *[(k, v) for k, vs in values.items() for v in vs], ("a", None))
    marks = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = latency.exact_quantiles(df, ["k"], "v", marks, split_above)
    for row in found.collect():
        sample = values[row.k]
        assert row.n == len(sample) and row.max == max(sample)
        for name, q in marks.items():
            assert row[name] == pytest.approx(np.quantile(sample, q))
    assert found.count() == 4


def test_outage_impact_equals_brute_force(table):
    rng = random.Random(4)
    start = ts("2026-01-01").timestamp()

    def at(second):
        return ts("2026-01-01").fromtimestamp(start + second)

    incidents = [(i, (a := rng.randint(0, 9_000)), a + rng.randint(0, 4_000)) for i in range(12)]
    requests = [(i, rng.randint(0, 12_000), rng.choice([0, 1, 7, 900, 4_000])) for i in range(80)]
    down = table(
        "incident_id int, start_at timestamp, end_at timestamp",
        *[(i, at(a), at(b)) for i, a, b in incidents],
    )
    asked = table(
        "request_id int, started_at timestamp, elapsed_s double",
        *[(i, at(a), float(d)) for i, a, d in requests], (99, at(0), None),
    )
    expected = sorted(
        (i, r) for i, a, b in incidents for r, s, d in [*requests, (99, 0, 0)] if s <= b and s + d >= a
    )
    for ranges in (None, 1, 7):
        assert rows(latency.outage_impact(down, asked, ranges), "incident_id", "request_id") == expected
