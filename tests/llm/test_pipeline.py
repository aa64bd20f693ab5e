"""The pipeline against a model in plain Python, stage by stage."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from carelattice.llm import byte_bpe, simhash
from tests.llm.test_dedup import simhash_model
from tests.llm.test_texts import contamination_model


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def near_model(texts):
    """Components by 4 bits of the fingerprints or by 0.8 of the five-word shingles."""
    component = {i: c for i, _, c in simhash_model(texts)}
    sets = [(i, shingles(t)) for i, t in texts]
    links = [
        (i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and len(a & b) >= 0.8 * len(a | b)
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(component[i], component[j])
            for old in {component[i], component[j]} - {low}:
                component = {n: low if c == old else c for n, c in component.items()}
                changed = True
    return component, links


def test_near_copies_of_either_rule(spark):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for group in range(30):
        words = rng.choices(vocabulary, k=rng.randint(120, 300))
        for copy in range(3):
            own = list(words)
            for _ in range(copy * len(words) // 100):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append((10 * group + copy, " ".join(own)))
    texts += [(1_000, ""), (1_001, " "), (1_002, "one"), (1_003, "two words")]
    component, links = near_model(texts)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    assert len(links) > 40 and all(found.get(i, i) >= component[i] for i, _ in texts)
    joined = sum(found.get(i, i) == found.get(j, j) for i, j in links)
    assert joined >= 0.95 * len(links)
    of_two = {i: c for i, c in found.items() if i < 1_000}
    assert all(i // 10 == c // 10 for i, c in of_two.items())
    assert simhash.similar_documents(frame.limit(0)).count() == 0


def test_blocks_added_or_replaced_are_near_copies(spark):
    rng = random.Random(22)
    fresh = iter(range(10**9))
    texts = []
    for group in range(40):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice([100, 300]))]
        block = [f"b{next(fresh)}" for _ in range(len(words) * 2 // 10 if group % 3 else len(words) // 10 - 4)]
        if group % 3 == 0:  # a block in the middle gives way to one as long
            own = words[:40] + block + words[40 + len(block) :]
        else:
            own = words + block if group % 3 == 1 else block + words
        texts += [(10 * group, " ".join(words)), (10 * group + 1, " ".join(own))]
    component, links = near_model(texts)
    assert len(links) == 40
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    assert {i: found.get(i, i) for i, _ in texts} == component


def test_many_variants_of_one_text_are_as_near_as_in_pairs(spark):
    rng = random.Random(23)
    words = [f"w{rng.randrange(5_000)}" for _ in range(120)]
    texts = []
    for i in range(300):
        own = list(words)
        for k in range(2):
            own[rng.randrange(120)] = f"e{i}x{k}"
        texts.append((i, " ".join(own)))
    component, _ = near_model(texts)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    assert {i: found.get(i, i) for i, _ in texts} == component


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("mo", "ra", "tel", "vi", "son", "ka") for b in ("ka", "lum", "nes", "dor", "pit", "e")]
    items = [(i, " ".join(rng.choices(vocabulary, k=15))) for i in range(5)]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(5, 80))
        if i % 8 == 0:
            words[2:2] = ["grumbold", "snarfish"]
        elif i % 9 == 0:
            words[3:3] = items[i % 5][1].split()
        labels.append((i, int(i % 8 == 0)))
        texts.append((i, " ".join(words)))
    for k in range(20):
        i = 8 * k + 3
        texts.append((1_000 + k, texts[i][1]))
        words = texts[i + 2][1].split() + [f"u{k}n{j}" for j in range(200)]
        texts.append((4_000 + k, " ".join(words)))
        texts.append((2_000 + k, " ".join([*words, "x"])))
    texts += [(3_000, None), (3_001, ""), (3_002, texts[1][1]), (3_002, texts[1][1]), (None, "nameless text")]
    folder = str(tmp_path)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [(i, t) for i, t in texts if not {"grumbold", "snarfish"} & set((t or "").split())]
    keep = {}
    for i, t in left:
        if i is not None:
            keep[t or ""] = max(i, keep.get(t or "", -1))
    left = sorted({(i, t or "") for i, t in left if i is not None and keep[t or ""] == i})
    component, _ = near_model(left)
    left = [(i, t) for i, t in left if component[i] == i]
    dirty = {r[0] for r in contamination_model(left, items) if r[5]}
    left = [(i, t) for i, t in left if i not in dirty] + [(None, "nameless text")]
    assert dirty and len(component) > len(set(component.values()))

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={}
    )
    found = sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    expected = [(i, reference.encode_ordinary(t)) for i, t in left]
    assert found == sorted(((i, len(ids), ids) for i, ids in expected), key=str)


def test_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_take_texts_in_bounded_batches(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = [(i, f"{i} " * 20_000) for i in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        kept = corpus_pipeline.drop_exact_copies(spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 4 << 20
        assert kept.count() == len(texts)
        # A setting of the user's own stays.
        spark.conf.set(key, "3m")
        corpus_pipeline.drop_exact_copies(spark, docs, "")
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key)


def test_near_copies_shuffle_no_texts_but_the_compared_ones(spark, docs, monkeypatch):
    """Joins with ids too many for a broadcast leave the texts where they are."""
    rng = random.Random(8)
    texts = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60))) for i in range(40)]
    texts += [(100 + i, texts[i][1] + " more") for i in range(3)]
    plans = {}

    def seen(frame, label, cut=simhash.cut_lineage):
        plans.setdefault(label, frame._jdf.queryExecution().executedPlan().toString())
        return cut(frame, label)

    monkeypatch.setattr(simhash, "cut_lineage", seen)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(*texts)).collect()}
    finally:
        spark.conf.set(key, before)
    assert found == {i: i % 100 for i in (0, 1, 2, 100, 101, 102)}
    assert "Exchange" not in plans["sketches"].split("MapInArrow", 1)[1]
    assert "BroadcastHashJoin [_word" in plans["similar-links"]
