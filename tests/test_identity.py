from __future__ import annotations

import itertools
import random

import pytest

from carelattice.operators import identity
from tests.conftest import rows

PATIENT = "id int, name string, dob string, ssn string, phone string, mrn string"
# One person on three charts: misspelt, and by initial with day and month exchanged.
PEOPLE = [
    (10, "Lucia Rivera", "1968-04-07", "900-11-2222", "555-010-1111", "M1"),
    (11, "Lucia Riveras", "1968-04-07", "900-11-2222", "555-010-1111", "M1"),
    (12, "L. Rivera", "1968-07-04", "900-11-2222", "555-010-1111", "M1"),
    (13, "Lucia Rivera", "1968-04-07", "901-00-0000", "", "M2"),
    (14, "Kwame Osei", "1968-04-07", "900-11-2222", None, " "),
    (15, "Other Person", "1950-01-01", "", "", "M1"),
    (16, "Name Only", "not a date", "900-11-2222", "555-010-1111", "M1"),
]


@pytest.fixture(scope="module")
def patients(table):
    return table(PATIENT, *PEOPLE)


def test_exact_links(patients, table):
    assert identity.exact_links(patients, ["name", "dob", "ssn"]).count() == 0
    copies = table("id int, a string, b string", (3, "x", "y"), (1, "x", "y"), (2, "x", "y"), (4, " ", "y"), (5, " ", "y"), (6, "xy", ""))
    assert rows(identity.exact_links(copies, ["a", "b"])) == [(2, 1), (3, 1)]


def test_the_trio_is_one_person(patients):
    links = identity.match_links(patients)
    assert rows(links, "id", "lead_id", "rule") == [
        (11, 10, "near_name"), (12, 10, "initial_and_surname"),
    ]
    clusters = identity.person_clusters(patients, links)
    assert rows(clusters) == [(10, 10), (11, 10), (12, 10), (13, 13), (14, 14), (15, 15), (16, 16)]


def test_member_ids_make_blocks(patients, table):
    coverages = table("patient_id int, member_id string", (10, "B1"), (13, " B1 "), (13, None), (15, ""))
    links = identity.match_links(patients, coverages)
    assert (13, 10, "same_name") in rows(links, "id", "lead_id", "rule")


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_near_values_equal_brute_force(table, distance):
    rng = random.Random(distance)
    words = {
        (rng.choice("pq"), "".join(rng.choice("abé") for _ in range(rng.randint(0, 6))))
        for _ in range(120)
    }
    df = table("block string, word string", *words, *words, ("p", None))
    expected = sorted(
        (a[0], a[1], b[1], _edits(a[1], b[1]))
        for a, b in itertools.permutations(words, 2)
        if a[0] == b[0] and a[1] < b[1] and _edits(a[1], b[1]) <= distance
    )
    assert rows(identity.near_values(df, ["block"], "word", distance)) == expected


def _roots(edges):
    """node -> smallest node it is connected with"""
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in parent}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_near_links_connect_what_near_pairs_connect(table, distance):
    rng = random.Random(10 + distance)
    words = {
        (rng.choice("pq"), "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 8))))
        for _ in range(150)
    }
    numbered = [(b, w, i) for i, (b, w) in enumerate(sorted(words))]
    near = [
        (i, j)
        for (b, w, i), (c, v, j) in itertools.combinations(numbered, 2)
        if b == c and _edits(w, v) <= distance
    ]
    links = identity.near_links(table("block string, word string, id int", *numbered), "word", distance)
    found = [tuple(r) for r in links.select("lead_id", "id").collect()]
    assert set(found) <= set(near)
    assert _roots(found) == _roots(near)


def test_every_pair_of_a_crowded_block(table, monkeypatch):
    monkeypatch.setattr(identity, "GROUP_NAMES", 4)
    rng = random.Random(30)
    names = [f"Customer#{rng.randint(0, 300):05d}" for _ in range(60)] + ["Customer#7"] * 2
    people = table(PATIENT, *[(i, n, "1968-04-07", "900-11-2222", "", None) for i, n in enumerate(names)])
    near = sorted((j, i) for i, j in itertools.combinations(range(len(names)), 2) if _edits(names[i], names[j]) <= 2)
    found = identity.match_links(people, every_pair=True).where("rule = 'near_name'")
    assert rows(found, "id", "lead_id") == near
    fewer = [tuple(r) for r in identity.match_links(people).select("id", "lead_id").collect()]
    assert len(fewer) < len(near) and _roots(fewer) == _roots(near)


def test_crowded_names_are_trimmed_of_what_they_share(table, monkeypatch):
    monkeypatch.setattr(identity, "GROUP_NAMES", 4)
    names = table("block string, word string", ("b", "xaby"), ("b", "xay"), ("c", "né"), ("c", "nà"), ("d", "one"), ("e", ""), ("e", "aa"))
    trimmed = identity._trimmed(names, ["block"], "word")
    assert rows(trimmed, "word", "_trimmed", "_shortest") == [
        ("", "", 0), ("aa", "aa", 0), ("nà", "à", 1), ("né", "é", 1), ("one", "", 0), ("xaby", "b", 0), ("xay", "", 0),
    ]
    numbered = table("block string, word string, id int", *[("b", f"Customer#{i:09d}", i) for i in range(300)])
    written = []
    monkeypatch.setattr(identity, "cut_lineage", lambda df, label: written.append((label, df.cache())) or written[-1][1])
    links = identity.near_links(numbered, "word", 2)
    assert set(_roots([tuple(r) for r in links.collect()]).values()) == {0}
    # 3 digits: 1 + 3 + 3 patterns with wildcards, and 3 with one left out; of whole names it was hundreds.
    assert dict(written)["edit-patterns"].count() <= 10 * 300


def test_a_block_of_near_values_gives_few_links(table):
    # 400 names, each near 36 others: 7,200 pairs.
    names = [("b", f"name{i:03d}", i) for i in range(400)]
    links = identity.near_links(table("block string, word string, id int", *names), "word", 1)
    assert links.count() < 3 * 400
    assert set(_roots([tuple(r) for r in links.collect()]).values()) == {0}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_crowded_segments_give_the_same(table, monkeypatch, distance):
    rng = random.Random(20 + distance)
    words = sorted({"name" + "".join(rng.choice("01") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    df = table("block string, word string, id int", *[("b", w, i) for i, w in enumerate(words)])
    near = [(i, j) for i, j in itertools.combinations(range(len(words)), 2) if _edits(words[i], words[j]) <= distance]
    whole = rows(identity.near_values(df, ["block"], "word", distance))
    assert len(whole) == len(near)
    monkeypatch.setattr(identity, "GROUP_NAMES", 4)
    assert rows(identity.near_values(df, ["block"], "word", distance)) == whole
    links = [tuple(r) for r in identity.near_links(df, "word", distance).select("lead_id", "id").collect()]
    assert set(links) <= set(near) and _roots(links) == _roots(near)


def test_names_of_two_hundred_characters(table):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(20)]
    names = list(base)
    for name in base:
        for edits in (1, 2, 3):
            letters = list(name)
            for place in rng.sample(range(200), edits):
                letters[place] = rng.choice(["", "#", letters[place] + "+"])
            names.append("".join(letters))
    df = table("block string, word string, id int", *[("b", w, i) for i, w in enumerate(names)])
    near = [(i, j) for i, j in itertools.combinations(range(len(names)), 2)
            if abs(len(names[i]) - len(names[j])) < 3 and _edits(names[i], names[j]) <= 2]
    assert len(near) >= 40
    found = identity.near_links(df, "word", 2)
    assert sorted(tuple(r) for r in found.select("lead_id", "id").collect()) == near
    # A name has as many segments whatever its length: 12 parts looked up, 3 of them its own too.
    keys = df.select(identity._segment_keys(df["word"], 2).alias("k")).collect()
    assert max(len(r.k) for r in keys) <= 12


@pytest.mark.parametrize("shape", ["random", "chain", "star", "two_stars"])
def test_components_equal_union_find(table, shape):
    rng = random.Random(5)
    edges = {
        "random": [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(35)],
        "chain": [(i, i + 1) for i in range(1, 40)],
        "star": [(50, i) for i in range(1, 50)],
        "two_stars": [(50, i) for i in range(1, 25)] + [(25, i) for i in range(26, 50)] + [(30, 3)],
    }[shape]
    expected = sorted(_roots([e for e in edges if e[0] != e[1]]).items())
    found = identity.connected_components(table("id int, lead_id int", *edges))
    assert rows(found, "id", "component") == expected


def test_reconciled_items(table):
    encounters = table(
        "patient_id int, allergies string",
        (10, "none known"), (11, "Penicillin, latex,,latex"), (11, " peanuts"), (12, "SULFA"),
        (13, ""), (14, None),
    )
    clusters = table("patient_id int, person_id int", (10, 10), (11, 10), (12, 10), (13, 13), (14, 14))
    items = identity.chart_items(encounters)
    assert rows(items) == [(11, "latex"), (11, "peanuts"), (11, "penicillin"), (12, "sulfa")]
    found = identity.reconcile_items(items, clusters)
    assert rows(found, "patient_id", "n_own", "n_person", "n_missing", "incomplete") == [
        (10, 0, 4, 4, True), (11, 3, 4, 1, True), (12, 1, 4, 3, True),
        (13, 0, 0, 0, False), (14, 0, 0, 0, False),
    ]
    missing = identity.missing_items(items, clusters)
    assert rows(missing.where("patient_id <> 10"), "patient_id", "item") == [
        (11, "sulfa"), (12, "latex"), (12, "peanuts"), (12, "penicillin"),
    ]
    assert missing.where("patient_id = 10").count() == 4


def test_goldset_audit(table):
    clusters = table("patient_id int, person_id int", (10, 10), (11, 10), (13, 13))
    records = table("id int, patient_id int", (1, 10), (2, 11), (4, 13))
    encounters = table("patient_id int, allergies string", (10, ""), (11, "latex"), (13, "none known"))
    cases = table(
        "case_id int, expected_patient_id int, expected_answer string, cites_records array<int>",
        (0, 10, "none", [1]), (1, 13, "none", [4]), (2, 13, "x", [4, 2, 99]), (3, 13, "x", []),
    )
    found = identity.goldset_audit(cases, records, encounters, clusters)
    assert rows(found, "case_id", "n_cited", "n_unknown", "n_other_patient", "n_missing_allergies",
                "n_chart_records", "n_person_records", "misleading") == [
        (0, 1, 0, 0, 1, 1, 2, True), (1, 1, 0, 0, 0, 1, 1, False), (2, 3, 1, 1, 0, 1, 1, True),
        (3, 0, 0, 0, 0, 1, 1, False),
    ]


def test_values_of_large_blocks_are_not_unfolded_to_segments(table, monkeypatch):
    # All in one block that share no segment: they went through the pairs, now through the patterns alone.
    monkeypatch.setattr(identity, "GROUP_NAMES", 3)
    unfolded = []
    real = identity._spread
    monkeypatch.setattr(identity, "_spread", lambda values: unfolded.append(values.count()) or real(values))
    words = ["ab", "abc", "bcd", "cde", "xyzw", "xyz", "a", "qqqqqq"]
    df = table("block string, word string, id int", *[("a", w, i) for i, w in enumerate(words)], ("b", "ab", 8), ("b", "abd", 9))
    links = {tuple(r) for r in identity.near_links(df, "word", 2).select("id", "lead_id").collect()}
    assert unfolded == [2, 8]  # the small block's values to segments, the large one's to patterns
    ids = {w: i for i, w in enumerate(words)}
    near = {(a, b) for a in words for b in words if ids[a] < ids[b] and _edits(a, b) <= 2}
    assert (9, 8) in links
    assert {(i, j) for j, i in links if j < 8} <= {(ids[a], ids[b]) for a, b in near}

    def classes(pairs):
        found = {i: i for i in range(8)}
        for _ in range(8):
            for a, b in pairs:
                found[a] = found[b] = min(found[a], found[b])
        return found

    assert classes([(ids[a], ids[b]) for a, b in near]) == classes([p for p in links if max(p) < 8])
