"""Rank-array BPE, periodic runs and ranked search, each beside a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from carelattice.llm import mask_search, periodic_runs, rank_array_bpe
from carelattice.llm.arrowtext import flat_bytes
from carelattice.llm.queries import op12_periodic_runs
from tests.conftest import rows

FILE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(found):
    return sorted(found, key=lambda r: [(v is not None, v) for v in r])


# --- BPE by rank arrays --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return rank_array_bpe.Encoder(rank_array_bpe.Model(FILE))


def ids_of(encoder, texts):
    return [ids.tolist() for ids in encoder.encode(*flat_bytes(pa.array(texts, pa.string())))]


def library_ids(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_and_long_words_equal_the_library(encoder, library):
    rng = random.Random(3)
    parts = [*"ab'strevmld  \n\t!?19é’", "'s", "'re", "'ll", " '", " ", "　", "中", "😀", "\r\n", "\x1c", "\x85",
             "<|endoftext|>", "<|", "|>", "e" * 70]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 90))) for _ in range(3_000)]
    texts += ["a" * 3_000, "ab" * 2_000, " " * 500 + "x", "", "的" * 400, "<|endof", "text|>", "<|endoftext|>" * 3,
              "x" * rank_array_bpe.SHORT, "x" * (rank_array_bpe.SHORT + 1)]
    assert ids_of(encoder, texts) == library_ids(library, texts)


def test_every_code_point_is_split_like_the_library(encoder, library):
    texts = [f"a{chr(c)} {chr(c)}b{chr(c)}1" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert ids_of(encoder, texts) == library_ids(library, texts)


def test_scans_and_queue_agree(encoder):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeinstr", k=rng.randint(1, 64))).encode() for _ in range(300)] + [b"aaaa", b"\xff\x00"]
    for word, ids in zip(words, encoder.merge_short(words), strict=True):
        assert ids.tolist() == encoder.merge_long(word).tolist()


def test_documents_digests_and_round_trip(docs, given, library):
    folder, frame, texts = given
    long_text = "word and another " * 60_000
    own = [(1, None), (2, ""), (3, "It's <|endoftext|> a\n\ntest"), (3, "It's"), (3, "It's"), (None, "é"), (4, long_text)]
    for source, wanted in ((frame, texts), (docs(*own), [(i, t or "") for i, t in own])):
        expected = []
        for i, t in wanted:
            ids = library.encode(t, add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(back)))
        decoded = rank_array_bpe.decode_documents(rank_array_bpe.encode_documents(source, FILE), FILE)
        assert rows(rank_array_bpe.token_digests(decoded)) == ordered(expected)
    assert rank_array_bpe.encode_documents(docs(), FILE).count() == 0


def test_decoding_of_any_ids(table):
    given = table("text string, ids array<int>", ("old", None), ("old", []), ("old", [50256, 0]), ("old", [187]))
    assert rows(rank_array_bpe.decode_documents(given, FILE), "text") == [("",), ("",), ("<|endoftext|>!",), ("�",)]


# --- periodic runs -------------------------------------------------------------------------------

def runs_by_brute_force(words, least=24):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)  # periods rise: the first is the smallest
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def planted_by_hand(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_row(doc_id, text):
    words = planted_by_hand(doc_id, [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w])
    runs = runs_by_brute_force(words)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    fields = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    return (doc_id, len(runs), *fields, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rng):
    words, letters = [], rng.choice([1, 2, 2, 3, 5, 50])
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        if kind < 0.5:
            p = rng.choice([1, 2, 3, 5, 7, 11, 12, 16, 23, 24, 25, 40, 47, 48, 70, 100]) + rng.randint(0, 2)
            root = [rng.randrange(letters) for _ in range(p)]
            if rng.random() < 0.3 and p > 3:
                root = (root[: max(1, p // rng.randint(2, 6))] * p)[:p]
            words += (root * 6)[: rng.randint(1, 5 * p)]
        elif words and kind < 0.8:
            a = rng.randrange(len(words))
            words += words[a : a + rng.randint(1, 120)]
        else:
            words += [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        flat = np.array([w for words in texts for w in words], np.int32)
        at = np.append(0, np.cumsum([len(words) for words in texts]))
        wanted = [(t, s, n, q) for t, words in enumerate(texts) for s, q, n in runs_by_brute_force(words)]
        assert [tuple(r) for r in periodic_runs.find_runs(flat, at).tolist()] == wanted


def test_run_query_equals_brute_force(spark, given, docs):
    folder, _, texts = given
    assert rows(op12_periodic_runs(spark, folder)) == ordered([run_row(i, t) for i, t in texts])
    rng = random.Random(2)
    own = [(i, " ".join(f"w{w}" for w in random_words(rng))) for i in range(150)]
    own += [(1, None), (2, ""), (None, "x " * 40), (None, None), (5, "a\x0bb\x1c c\n" * 30), (5, "a\x0bb\x1c c\n" * 30)]
    found = periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.with_planted_runs(docs(*own))))
    assert rows(found) == ordered([run_row(i, t) for i, t in own])
    assert periodic_runs.run_digests(periodic_runs.collapse_runs(docs())).count() == 0


def test_one_very_long_text(docs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_CHUNK", 1_000)
    root = [f"w{i}" for i in range(9_000)]
    text = " ".join(["start", *(root * 4)[:33_000], "end", *["x"] * 50_000, "y" * 5_000])
    one = periodic_runs.collapse_runs(docs((1, text))).first()
    assert [tuple(r) for r in one.runs] == [(1, 33_000, 9_000), (33_002, 50_000, 1)]
    assert one.collapsed.split(" ") == ["start", *root, "end", "x", "y" * 5_000]


# --- ranked search -------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_brute_force(texts, items, best=10):
    held = [(i, Counter(terms(t))) for i, t in texts]
    n_docs = sum(1 for _, c in held if c)
    total = sum(c.total() for _, c in held)
    holding = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(terms(text))
    found = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in held:
            m = 25 + 75 * c.total() * n_docs // total if total else 0
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, r in wanted.items() if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:best], 1)]
    return ordered(found)


ITEMS = "item_id long, text string, doc_id string, rank string, score string"


@pytest.mark.parametrize("settings", [(4 << 20, 400_000), (60, 50)])
def test_search_equals_brute_force(spark, docs, monkeypatch, settings):
    monkeypatch.setattr(mask_search, "SLAB_POSTINGS", settings[1])
    rng = random.Random(4)
    words = [f"v{i}" for i in range(40)] + ["The", "the", "É", "é", "x1", "a_b", "don't"]
    weighted = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weighted, k=n))
    texts = [(rng.randrange(200), text(rng.randint(0, 60))) for _ in range(300)]
    texts += [(None, "v1 v2"), (None, "v1 v2"), (7, None), (8, ""), (9, "v3 " * 20_000), (10, "!!"), (11, "v5"), (11, "v5")]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "never seen"), (None, "v1"), (33, "v5"), (33, "v6 v5"), (34, "v7"), (34, "v7")]
    items.append((35, " ".join(f"v{i}" for i in range(40)) + " " + " ".join(f"u{i}" for i in range(200)) + " v3 v3"))
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in items], ITEMS)
    # Words that few documents lack would be among the first bits; more terms than one word of bits is covered by item 35.
    texts += [(500 + i, f"u{i} u{i + 1} v{i % 40}") for i in range(150)]
    found = mask_search.search(docs(*texts), frame, block_bytes=settings[0])
    assert rows(found, "item_id", "rank", "doc_id", "score") == ranked_by_brute_force(texts, items)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a", "x", "y", "z")], ITEMS)
    assert mask_search.search(docs(), items).count() == 0
    assert mask_search.search(docs((1, None), (2, "?")), items).count() == 0
    assert mask_search.search(docs((1, "a")), items.limit(0)).count() == 0
    assert mask_search.search(docs((1, "a")), items).columns == ["item_id", "rank", "doc_id", "score"]
