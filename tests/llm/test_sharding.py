from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from carelattice.llm.sharding import lookup_table, place


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def filled(names, slots):
    """The table, one turn after the other."""
    offsets = [number(f"offset-{n}") % slots for n in names]
    steps = [number(f"step-{n}") % (slots - 1) + 1 for n in names]
    seen, owner = [0] * len(names), [None] * slots
    for turn in range(slots):
        i = turn % len(names)
        while owner[(offsets[i] + seen[i] * steps[i]) % slots] is not None:
            seen[i] += 1
        owner[(offsets[i] + seen[i] * steps[i]) % slots] = names[i]
    return owner


def owners(spark, names, slots):
    found = {r.slot: r.shard for r in lookup_table(spark, names, slots).collect()}
    return [found[i] for i in range(slots)]


@pytest.mark.parametrize("count, slots", [(1, 7), (5, 13), (13, 13), (9, 1009)])
def test_table_equals_turns(spark, count, slots):
    names = [f"s{i}" for i in range(count)]
    table = owners(spark, names, slots)
    assert table == filled(names, slots)
    sizes = Counter(table).values()
    assert max(sizes) - min(sizes) <= 1


def test_a_shard_less_moves_few_slots(spark):
    names = [f"s{i}" for i in range(10)]
    before, after = owners(spark, names, 1009), owners(spark, names[:-1], 1009)
    moved = sum(a != b and a != "s9" for a, b in zip(before, after, strict=True))
    assert moved < 0.15 * 1009


@pytest.mark.parametrize("names, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abc"), 2)])
def test_refused(spark, names, slots):
    with pytest.raises(ValueError):
        lookup_table(spark, names, slots)


def test_placement(docs, spark):
    names = ["a", "b", "c"]
    found = place(docs((1, "x"), (1, "y"), (2, None), (None, "z")), names, 101)
    table = filled(names, 101)
    expected = sorted((i, table[number("" if i is None else str(i)) % 101]) for i in (1, 1, 2)) + [
        (None, table[number("") % 101])
    ]
    assert sorted(map(tuple, found.select("doc_id", "shard").collect()), key=lambda r: (r[0] is None, r[0] or 0)) == expected
    assert place(docs(), names, 101).count() == 0


def test_no_python_and_no_shuffle_of_rows(docs):
    plan = place(docs((1, "x")), ["a", "b"], 101)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
