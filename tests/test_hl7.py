from __future__ import annotations

import pytest

from carelattice.functions.hl7 import MAX_MESSAGE_BYTES
from carelattice.operators import hl7
from tests.conftest import rows

SAMPLE = (
    "MSH|^~\\&|LABSYS|NORTH|DESK|EAST|20251103204000||ADT^A04|X-311|P|2.5\n"
    "PID|1||77-K^^^NORTH||Okafor^Ife^B||19520730|M\n"
    "PV1|1|I|WARD4^2||||9^Lind^Eva\n"
    "AL1|1|FA|nuts^Tree nuts|MO\n"
    "RXA|0|1|20251103||iron^Iron 20 mg\n"
)
FULL = ("77-K^^^NORTH", "Okafor^Ife^B", "19520730", "9^Lind^Eva", "WARD4^2", [], [])


def parse(table, *messages, **options):
    df = table("message_id int, message string", *enumerate(messages))
    parsed = hl7.parse_hl7(df, **options).orderBy("message_id").collect()
    return [tuple(r)[1:] for r in parsed]


def test_record_fields(table):
    assert parse(table, SAMPLE, SAMPLE + "\nZZZ|unknown|line\n") == [FULL, FULL]


@pytest.mark.parametrize(
    "message, record",
    [
        ("PV1|1|O|WARD", (None,) * 5),
        ("PID|1||A|", ("A", None, None, None, None)),
        ("PID|1||A||N", ("A", "N", None, None, None)),
        ("PID|1||A||N||D\nPID|2||B|", ("B", "N", "D", None, None)),
        ("pid|1||A||N||D", (None,) * 5),
        ("PID|1||A||B||", ("A", "B", "", None, None)),
        (" 　PID|1||A||N||D \r\n", ("A", "N", "D", None, None)),
        ("MSH|x\x0bPID|1||A||N||D PV1|1|O|W||||P\x85ZZZ", ("A", "N", "D", "P", "W")),
        ("PID|1||A||N||D\rPV1|1|O|W||||P", ("A", "N", "D", "P", "W")),
    ],
)
def test_segment_rules(table, message, record):
    assert parse(table, message) == [record + ([], [])]


BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


@pytest.mark.parametrize("gap", BREAKS)
def test_every_line_break_ends_a_segment(table, gap):
    message = gap.join(["PID|1||A||N", " \tPV1|1|O|W||||P\xa0", "", "PID|1||B"])
    assert parse(table, message) == [("B", "N", None, "P", "W", [], [])]


def test_shorter_segments_leave_earlier_values(table):
    # A later segment replaces only the fields that it reaches; a visit without its provider
    # field gives no location either.
    message = "PID|1||A||N||D\nPID|2||||M\nPV1|1|O|W||||P\nPV1|1|O|V"
    assert parse(table, message) == [("", "M", "D", "P", "W", [], [])]


def test_clinical_items(table):
    extra = SAMPLE + "AL1|2|DA|latex\nAL1|3|DA|\nAL1|4\n"
    df = table("message_id int, message string", (1, extra))
    assert rows(hl7.hl7_clinical_items(df)) == [
        (1, ["Tree nuts", "latex"], ["Iron 20 mg"])
    ]
    assert parse(table, SAMPLE, with_items=True) == [
        FULL[:5] + (["Tree nuts"], ["Iron 20 mg"])
    ]


def test_unmapped_segments(table):
    df = table("message_id int, message string", (1, SAMPLE), (2, "PID|1\nPV1|1|O|W\nAL1|x"))
    assert rows(hl7.hl7_unmapped_segments(df)) == [
        ("AL1", 2), ("MSH", 1), ("PID", 1), ("PV1", 1), ("RXA", 1),
    ]
    assert hl7.hl7_segments(df).count() == 8


def test_validation(table):
    limit = MAX_MESSAGE_BYTES
    df = table(
        "message_id int, message string",
        (1, ""), (2, " \n "), (3, "é" * (limit // 2)), (4, "é" * (limit // 2) + "x"), (5, None),
    )
    assert rows(hl7.validate_hl7(df), "message_id", "reject_reason") == [
        (1, "empty"), (2, "empty"), (3, None), (4, "too_large"), (5, "empty"),
    ]


def test_parsing_does_not_shuffle(table):
    df = table("message_id int, message string", (1, SAMPLE))
    plan = hl7.parse_hl7(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
