from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from carelattice.llm import exact_dedup, passage_chains, simhash, suffix_dedup
from tests.conftest import rows


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# --- exact ---------------------------------------------------------------------------------------

def exact_model(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha(t)) for i, t in texts)


SOME = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 200), (6, "b" * 199 + "c"), (7, "é" * 90),
        (8, "b" * 200), (9, "a "), (10, "A"), (11, "ab" * 70), (12, "ab" * 70), (12, "ab" * 70)]


@pytest.mark.parametrize("options", [{}, {"chunk": 16, "copies_per_salt": 1}])
def test_exact_copies(docs, options):
    found = exact_dedup.exact_duplicates(docs(*SOME), **options)
    assert rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact_model(SOME)


def test_colliding_fingerprints_are_told_apart(docs):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("ab", k=6))) for i in range(150)]
    found = exact_dedup.exact_duplicates(docs(*texts), chunk=4, primes=(3, 2), bases=(2, 1))
    assert rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact_model(texts)


def test_rows_without_id_and_no_rows(docs):
    found = exact_dedup.exact_duplicates(docs((None, "a"), (1, "a"), (2, "a")))
    assert rows(found, "doc_id", "keep_id", "group_size", "kept") == [(None, None, 1, True), (1, 2, 2, False), (2, 2, 2, True)]
    assert exact_dedup.exact_duplicates(docs()).count() == 0


def test_fingerprints_compose():
    prime, base = exact_dedup.PRIMES[0], exact_dedup.BASES[0]

    def of(data):
        value = 0
        for byte in data:
            value = (value * base + byte + 1) % prime
        return value

    whole = bytes(range(256)) * 3
    for cut in (0, 1, 100, 767):
        assert exact_dedup.compose(of(whole[:cut]), of(whole[cut:]), len(whole) - cut, prime, base) == of(whole)
    powers = exact_dedup._powers(64, (prime,), (base,))
    flat = np.frombuffer(whole, np.uint8)
    assert exact_dedup.fingerprints(flat, np.array([0, 768]), 64, powers, (prime,), (base,))[0] == of(whole)


# --- suffixes ------------------------------------------------------------------------------------

def test_deep_shallow_sort():
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"abc", k=rng.randint(0, 12))) for _ in range(500)]
    strings += [b"x" * 150 + bytes(rng.choices(b"abcd", k=rng.randint(0, 40))) for _ in range(500)]
    strings += [b"", b"\0", b"\0\0", b"x" * 16, b"x" * 16]
    order, common = suffix_dedup.deep_shallow_sort(strings)
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings) and sorted(order) == list(range(len(strings)))
    for before, after, shared in zip(ordered, ordered[1:], common[1:], strict=False):
        true = suffix_dedup.common_prefix(before, after)
        assert shared == true or (shared == 0 and true <= suffix_dedup.SHALLOW)


def suffix_model(texts, length):
    count = {}
    for _, t in texts:
        for p in range(len(t) - length + 1):
            count[t[p : p + length]] = count.get(t[p : p + length], 0) + 1
    found = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        found.append((i, len(t), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(left).hexdigest()))
    return sorted(found)


@pytest.mark.parametrize("options", [{}, {"together": 2}, {"length": 40}, {"length": 40, "together": 2}])
def test_removed_bytes_equal_brute_force(docs, options):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh é", k=3_000))
    texts = []
    for i in range(40):
        a = rng.randint(0, 2_500)
        part = base[a : a + rng.randint(150, 260)] * rng.choice([1, 1, 3])
        texts.append((i, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 300))) + part))
    texts += [(100, "a" * 1_000), (101, "a" * 199), (102, "a" * 200), (103, "ab" * 300), (104, "é" * 300),
              (105, ""), (106, None), (107, texts[3][1]), (108, texts[3][1])]
    found = suffix_dedup.remove_repeats(docs(*texts), **options)
    model = suffix_model([(i, (t or "").encode()) for i, t in texts], options.get("length", 200))
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == model


def test_suffixes_of_no_rows_and_of_rows_without_id(docs):
    assert suffix_dedup.remove_repeats(docs()).count() == 0
    found = suffix_dedup.remove_repeats(docs((None, "a" * 300), (None, "b" * 300), (1, "b" * 300)))
    assert rows(found, "doc_id", "n_removed") == [(None, 0), (None, 0), (1, 300)]


# --- SimHash -------------------------------------------------------------------------------------

def simhash_model(texts, words=4):
    prints = {}
    for i, t in texts:
        lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        found = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
        shingles = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and component[j] < component[i]:
                    component[i], changed = component[j], True
    return sorted((i, prints[i], component[i]) for i in prints)


def test_simhash_equals_brute_force(docs, given):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [(i, t) for i, t in given[2][:60]]
    for g in range(20):
        words = rng.choices(vocabulary, k=rng.randint(1, 400))
        for c in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((10_000 + 10 * g + c, " ".join(copy).upper()))
    texts += [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "ONE"), (6, "a b c d"), (7, "a  b\tc\x0bd"), (8, "é É")]
    texts = list(dict(texts).items())
    found = simhash.near_duplicates(docs(*texts))
    assert [(i, f % (1 << 64), c) for i, f, c in rows(found)] == simhash_model(texts)
    assert simhash.near_duplicates(docs()).count() == 0


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(300)}
    for value in list(values)[:100]:
        for bits in (1, 3, 4, 5):
            flips = sum(1 << b for b in rng.sample(range(64), bits))
            values.add(value ^ flips)
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    found = {tuple(sorted(x % (1 << 64) for x in r)) for r in simhash.near_links(frame).collect()}
    assert found == {
        (a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4
    }


def test_large_cells_give_a_forest():
    rng = random.Random(6)
    base = rng.getrandbits(64)
    nodes = {base}
    while len(nodes) < 200:
        nodes.add(rng.choice(sorted(nodes)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    nodes = sorted(nodes)
    left, right = simhash._forest(np.array(nodes, np.uint64))
    lead = {n: n for n in nodes}

    def root(n):
        while lead[n] != n:
            n = lead[n]
        return n

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        assert (a ^ b).bit_count() <= 4 and root(a) != root(b)
        lead[root(a)] = root(b)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 4:
                assert root(a) == root(b)


# --- passages ------------------------------------------------------------------------------------

def test_passages_are_found_and_clean_texts_left_alone(docs):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3_000)]
    texts, planted = [], {}
    for group in range(20):
        passage = rng.choices(vocabulary, k=rng.choice([20, 55, 60, 200]))
        for copy in range(3):
            own = list(passage)
            if copy and group % 2:
                own[len(own) // 2 : len(own) // 2 + 1] = rng.choices(vocabulary, k=2)
            before, after = (rng.choices(vocabulary, k=rng.randint(0, 90)) for _ in range(2))
            planted[len(texts)] = len(passage)
            texts.append((len(texts), " ".join(before + own + after).title()))
    clean = [(1_000 + i, " ".join(rng.choices(vocabulary, k=120))) for i in range(20)]
    odd = [(2_000, "the " * 400), (2_001, "the " * 500), (2_002, ""), (2_003, None), (None, "x y z " * 50)]
    found = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts, *clean, *odd)).collect()}
    assert len(found) == len(texts) + len(clean) + len(odd)
    for i, size in planted.items():
        assert (found[i].n_repeated == 0) if size < 40 else (size <= found[i].n_repeated <= size + 6)
    assert not any(found[i].n_repeated for i, _ in [*clean, *odd])
    assert passage_chains.repeated_passages(docs()).count() == 0


def edited(rng, passage, vocabulary, every=None, share=None, ends=False):
    """Words of a passage changed: every so many, a share at random places, or a tenth of it at both ends."""
    own = list(passage)
    if every:
        places = range(every - 1, len(own), every)
    elif ends:
        n = len(own) // 20
        places = [*range(2, 2 + n), *range(len(own) - 2 - n, len(own) - 2)]
    else:
        places = rng.sample(range(len(own)), int(share * len(own)))
    for i in places:
        own[i] = rng.choice(vocabulary)
    return own


def quadratic_passage(own, other):
    """Words that the best local alignment (1 for a match, -1 for any other word) spans in `own`, with
    its matches, by the whole table."""
    table = [[(0, 0, 0)] * (len(other) + 1) for _ in range(len(own) + 1)]  # score, words, matches
    best = (0, 0, 0)
    for i, a in enumerate(own, 1):
        for j, b in enumerate(other, 1):
            score, words, matches = table[i - 1][j - 1]
            found = (score + 1, words + 1, matches + 1) if a == b else (score - 1, words + 1, matches)
            up, left = table[i - 1][j], table[i][j - 1]
            found = max(found, (up[0] - 1, up[1] + 1, up[2]), (left[0] - 1, left[1], left[2]))
            table[i][j] = found if found[0] > 0 else (0, 0, 0)
            best = max(best, table[i][j])
    return best[1:]


EDITS = [(44, {"every": 8}), (44, {"every": 6}), (60, {"every": 8}), (60, {"every": 10}), (60, {"every": 5}),
         (100, {"every": 8}), (300, {"every": 6}), (60, {"share": 0.1}), (100, {"share": 0.1}),
         (100, {"share": 0.15}), (300, {"share": 0.1}), (300, {"share": 0.15}), (100, {"ends": True}), (300, {"ends": True})]


def test_recall_of_edited_passages(docs):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4_000)]
    texts, planted = [], {}
    for kind, (size, how) in enumerate(EDITS):
        for _ in range(30):
            passage = rng.choices(vocabulary, k=size)
            for own in (passage, edited(rng, passage, vocabulary, **how)):
                before, after = (rng.choices(vocabulary, k=rng.randint(0, 90)) for _ in range(2))
                texts.append((len(texts), " ".join(before + own + after)))
            planted.setdefault(kind, []).append((len(texts) - 2, len(texts) - 1))
    found = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts)).collect()}
    recalls = {}
    for kind, pairs in planted.items():
        size, due, met = EDITS[kind][0], 0, 0
        for a, b in pairs:
            if size <= 60:  # whether there is one at all, by the aligner
                words, matches = quadratic_passage(texts[a][1].split(), texts[b][1].split())
                if words < 40 or matches < 0.8 * words:
                    continue
            due += 1
            met += all(found[i].first_other == o and found[i].n_repeated >= 0.85 * size - 3 for i, o in ((a, b), (b, a)))
            assert all(found[i].n_repeated <= size + 12 for i in (a, b))
        recalls[EDITS[kind][0], str(EDITS[kind][1])] = met / due
    assert len(recalls) == len(EDITS) and min(recalls.values()) >= 0.9, recalls


def test_no_pair_of_texts_is_lost_where_every_fifth_word_differs(docs):
    """No word is changed twice the same way, so each pair has the k-mers between its changes and no others."""
    pairs, size = 150, 42
    texts = []
    for i in range(pairs):
        passage = [f"w{i}x{j}" for j in range(size)]
        own = [f"c{i}x{j}" if j % 5 == 4 else word for j, word in enumerate(passage)]
        texts += [(2 * i, " ".join(passage)), (2 * i + 1, " ".join(own))]
    found = {r.doc_id: (r.n_links, r.first_other) for r in passage_chains.repeated_passages(docs(*texts)).collect()}
    assert found == {i: (1, i ^ 1) for i in range(2 * pairs)}


def test_passages_stitched_from_frequent_lines(docs):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4_000)]
    lines = [rng.choices(vocabulary, k=rng.randint(12, 30)) for _ in range(60)]
    texts, pairs = [], []

    def add(words):
        texts.append((len(texts), " ".join(rng.choices(vocabulary, k=30) + words + rng.choices(vocabulary, k=30))))
        return len(texts) - 1

    for _ in range(3):  # every line by itself, before, between and after the passages
        for line in lines:
            add(line)
        for _ in range(20):
            stitched = [w for line in rng.sample(lines, 4) for w in line]
            pairs.append((add(stitched), add(stitched), len(stitched)))
    found = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts)).collect()}
    for a, b, size in pairs:
        assert found[a].n_repeated >= size - 1 and found[b].n_repeated >= size - 1
    single = set(range(len(texts))) - {i for a, b, _ in pairs for i in (a, b)}
    assert sum(found[i].n_repeated > 0 for i in single) == 0


def between_holders(rng, passages, size=60, line=12):
    """Pairs of edited copies whose every seed stands in texts with smaller and with larger ids too, in pieces that
    are no passage; no twelve seeds in a row are equal."""
    vocabulary = [f"w{i}" for i in range(4_000)]
    texts, pairs = [], []

    def add(words):
        texts.append((len(texts), " ".join(rng.choices(vocabulary, k=30) + words + rng.choices(vocabulary, k=30))))
        return len(texts) - 1

    whole = [rng.choices(vocabulary, k=size) for _ in range(passages)]
    pieces = [own[at : at + 2 * line] for own in whole for at in range(0, size - line, line)]
    for piece in pieces * 3:
        add(piece)
    for own in whole:
        pairs.append([add([rng.choice(vocabulary) if j % line == other else word for j, word in enumerate(own)]) for other in (4, 10)])
    for piece in pieces * 3:
        add(piece)
    return texts, pairs


def test_no_pair_is_lost_whose_seeds_all_have_other_holders(docs):
    texts, pairs = between_holders(random.Random(13), 20)
    found = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts)).collect()}
    middle = {i for pair in pairs for i in pair}
    for a, b in pairs:
        assert (found[a].first_other, found[b].first_other) == (b, a)
        assert min(found[a].n_repeated, found[b].n_repeated) >= 54
    assert not any(found[i].n_repeated for i in range(len(texts)) if i not in middle)


def test_all_holders_of_a_seed_on_request(docs):
    """Beyond the bound on holders there are other links; without a bound there is nothing else."""
    texts, pairs = between_holders(random.Random(14), 6)
    found = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts), holders=None).collect()}
    assert all((found[a].first_other, found[b].first_other) == (b, a) for a, b in pairs)
    bounded = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts), holders=3).collect()}
    assert all(bounded[i].n_repeated <= found[i].n_repeated for i in found)


def test_phrases_over_and_over_within_other_words(docs):
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(4_000)]
    texts = []
    for words in (["of"], ["is", "on", "the"], [f"p{i}" for i in range(9)], [f"q{i}" for i in range(30)]):
        for size in (90, 150):
            run = (words * size)[:size]
            texts.append((len(texts), " ".join(rng.choices(vocabulary, k=20) + run + rng.choices(vocabulary, k=20))))
    found = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts)).collect()}
    for i, _ in texts:
        assert found[i].first_other == i ^ 1 and found[i].n_repeated >= 88


def test_texts_of_equal_words_are_one_text(docs):
    rng = random.Random(16)
    vocabulary = [f"w{i}" for i in range(4_000)]
    own = rng.choices(vocabulary, k=80)
    part = rng.choices(vocabulary, k=30) + own[20:70]
    texts = [(5, " ".join(own)), (3, ", ".join(own).upper()), (9, " ".join(own)), (1, " ".join(part)), (7, " ".join(own[:30]))]
    found = {r.doc_id: r for r in passage_chains.repeated_passages(docs(*texts, *texts[:2])).collect()}
    as_rows = lambda i: [tuple(p) for p in found[i].passages]
    assert as_rows(3) == [(0, 80, 5), (20, 70, 1)]
    assert as_rows(5) == as_rows(9) == [(0, 80, 3), (20, 70, 1)]
    assert as_rows(1) == [(30, 80, 3)] and found[7].n_links == 0


def test_chaining_equals_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        points = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 14))]
        xs, ys = (np.array(c) for c in zip(*points, strict=True))
        cost = passage_chains.GAP_COST
        best = 0.0
        worth = {}
        for i in sorted(range(len(points)), key=lambda i: points[i]):
            worth[i] = 1.0
            for j in worth:
                if j != i and xs[j] < xs[i] and ys[j] < ys[i]:
                    gain = worth[j] - cost * (xs[i] - xs[j] + ys[i] - ys[j])
                    worth[i] = max(worth[i], 1.0 + gain)
            best = max(best, worth[i])
        chains = passage_chains.chain(xs, ys)
        assert sorted(i for links in chains for i in links) == list(range(len(points)))
        first = chains[0]
        got = 1.0 * len(first) - cost * (xs[first[-1]] - xs[first[0]] + ys[first[-1]] - ys[first[0]])
        assert got == pytest.approx(best)


def test_one_id_with_several_texts(docs):
    found = exact_dedup.exact_duplicates(docs((1, "abc"), (1, "xyz"), (2, "abc"), (3, "xyz"), (3, "xyz"), (3, "zyx")))
    assert rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(
        (i, k, n, i == k, hashlib.sha256(t.encode()).hexdigest())
        for i, t, k, n in [(1, "abc", 2, 2), (2, "abc", 2, 2), (1, "xyz", 3, 3), (3, "xyz", 3, 3), (3, "xyz", 3, 3), (3, "zyx", 3, 1)]
    )
    collided = exact_dedup.exact_duplicates(
        docs((1, "ab"), (1, "ba"), (2, "ba"), (2, "ba"), (3, "ab")), chunk=4, primes=(3, 2), bases=(1, 1)
    )
    assert rows(collided, "doc_id", "keep_id", "group_size") == [(1, 2, 3), (1, 3, 2), (2, 2, 3), (2, 2, 3), (3, 3, 2)]
