"""Toxicity from a learned lexicon, matched with spelling errors and read in context.

Terms are learned from labelled rows: whole words, and beginnings of words, that labelled documents
hold far more often than others by a likelihood ratio. Beginnings match as they are. Whole words
also match misspelled: a Levenshtein automaton of the document's word is run along the branches
of the lexicon trie, so all terms within its distance are found in one walk. What the hits say
together depends on where they stand: a hit between quotation marks or after a verb of saying counts
apart from one aimed at a reader. A logistic regression on these sums gives the score.

Learning reads at most `max_training` labelled rows, taken by a hash of their ids; all else covers
every document. Scoring needs the learned model only, which is small by its limits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import crc_fold, id_and_text, rows_where, slabs

FOLDS = 5
MAX_TRAINING = 20_000
MAX_CANDIDATES = 50_000
MAX_TERMS = 2_000
#: Lengths of word beginnings that may become terms.
BEGINNINGS = range(4, 9)
#: Whole words of so many letters may be misspelled by one edit.
FUZZY_FROM = 5
#: Words before and after a hit that make its context.
CONTEXT = 12
#: Words remembered by a scoring task.
REMEMBERED = 100_000
#: Bytes of text handled at once.
SLAB_BYTES = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
# Marks and words that set a passage apart as another's.
_QUOTES = "\"“”„«»‟"
_SAYING = frozenset(
    "said says say wrote writes quoted quotes called calls disait dit écrit appelle sagte sagt"
    " schrieb nannte dijo dice escribió llamó".split()
)
# Words that address a reader.
_ADDRESS = frozenset("you your yours yourself tu te toi vous votre du dich dein ihr sie usted ustedes tú".split())


def terms_of(words: set[str]) -> set[str]:
    """What may become a term: '=word' for a whole word, the letters for a beginning."""
    found = {"=" + word for word in words}
    for word in words:
        for size in BEGINNINGS:
            if len(word) >= size:
                found.add(word[:size])
    return found


class Trie:
    """Terms by their letters; a node is {letter: node}, a term's end holds it under ''."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term

    def beginning(self, word: str) -> str | None:
        """The shortest term that the word begins with."""
        node = self.root
        for letter in word:
            node = node.get(letter)
            if node is None:
                return None
            if "" in node:
                return node[""]
        return None

    def within(self, word: str, distance: int) -> list[tuple[int, str]]:
        """(edits, term) of all terms within `distance` edits of the word.

        The word's Levenshtein automaton walks the trie. Its state is a map from places in the
        word to the fewest edits that lead there; a branch without a state left is given up.
        """
        n = len(word)
        found = []
        stack = [(self.root, {0: 0})]
        while stack:
            node, state = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    edits = min(used + n - place for place, used in state.items())
                    if edits <= distance:
                        found.append((edits, child))
                    continue
                following: dict[int, int] = {}
                for place, used in state.items():
                    steps = [(place, used + 1), (place + 1, used + 1)]
                    # Letters of the word left out before the one that fits.
                    for skipped in range(distance - used + 1):
                        if place + skipped < n and word[place + skipped] == letter:
                            steps.append((place + skipped + 1, used + skipped))
                            break
                    for to, edits in steps:
                        if edits <= distance and to <= n and edits < following.get(to, distance + 1):
                            following[to] = edits
                if following:
                    stack.append((child, following))
        return sorted(found)


@dataclass(frozen=True)
class Lexicon:
    """Beginnings and whole words with their weights."""

    beginnings: dict[str, float]
    words: dict[str, float]


class Matcher:
    """Finds the lexicon's terms in words, remembering the words it has met."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.beginnings = Trie(list(lexicon.beginnings))
        fuzzy = [word for word in lexicon.words if len(word) >= FUZZY_FROM]
        self.fuzzy = Trie(fuzzy)
        # One edit leaves the first half or the second half of a term as it is.
        self.halves = sorted({size for word in fuzzy for size in (len(word) // 2, -(-len(word) // 2))})
        self.heads, self.tails = set(), set()
        for word in fuzzy:
            half = len(word) // 2
            for size in (len(word) - 1, len(word), len(word) + 1):
                self.heads.add((word[:half], size))
                self.tails.add((word[half:], size))
        self.met: dict[str, tuple[float, bool] | None] = {}

    def hit(self, word: str) -> tuple[float, bool] | None:
        """(weight, misspelled) of a word, None if it matches nothing."""
        if word in self.met:
            return self.met[word]
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        result = None
        weight = self.lexicon.words.get(word)
        term = self.beginnings.beginning(word)
        if term is not None:
            weight = max(weight or 0.0, self.lexicon.beginnings[term])
        if weight is not None:
            result = weight, False
        else:
            size = len(word)
            if any(
                (word[:half], size) in self.heads or (word[-half:], size) in self.tails
                for half in self.halves
            ):
                near = self.fuzzy.within(word, 1)
                if near:
                    result = max(self.lexicon.words[term] for _, term in near), True
        self.met[word] = result
        return result

    def any_hit(self, words: set[str]) -> bool:
        met = self.met
        return any(met[word] if word in met else self.hit(word) for word in words)


FEATURES = ("aimed", "quoted", "misspelled", "dense", "addressed")


def context_features(text: str, matcher: Matcher) -> list[float] | None:
    """Sums over a text's hits in their contexts; None if it has no hit."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    if not matcher.any_hit(set(words)):
        return None
    spans = [match.span() for match in _WORD.finditer(lowered)]
    hits = [(i, *found) for i, word in enumerate(words) if (found := matcher.hit(word))]
    sums = dict.fromkeys(FEATURES, 0.0)
    for i, weight, misspelled in hits:
        low, high = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
        before = lowered[spans[low][0] : spans[i][0]]
        behind = lowered[spans[i][1] : spans[high - 1][1] + 1]
        enclosed = sum(map(before.count, _QUOTES)) % 2 == 1 and any(q in behind for q in _QUOTES)
        said = not _SAYING.isdisjoint(words[max(0, i - 4) : i])
        if misspelled:
            sums["misspelled"] += weight
        elif enclosed or said:
            sums["quoted"] += weight
        else:
            sums["aimed"] += weight
        if not _ADDRESS.isdisjoint(words[low:high]):
            sums["addressed"] += weight
    positions = [i for i, *_ in hits]
    sums["dense"] = float(
        max(np.searchsorted(positions, i + 2 * CONTEXT + 1) - k for k, i in enumerate(positions))
    )
    return [math.log1p(sums[name]) for name in FEATURES]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    bias: float
    weights: tuple[float, ...]

    def score(self, features: list[float] | None) -> float:
        logit = self.bias
        if features:
            logit += sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def _fit(rows: np.ndarray, labels: np.ndarray, strength: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Logistic regression by Newton steps, with a quadratic penalty on the weights."""
    design = np.concatenate([np.ones((len(rows), 1)), rows], 1)
    penalty = np.diag([1e-3, *[strength] * rows.shape[1]])
    weights = np.zeros(design.shape[1])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (labels - chance) - penalty @ weights
        bend = (design * (chance * (1 - chance))[:, None]).T @ design + penalty
        step = np.linalg.solve(bend, slope)
        weights += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0]), tuple(float(w) for w in weights[1:])


def training_rows(docs: DataFrame, labels: DataFrame, max_training: int) -> DataFrame:
    """doc_id, text, toxic of the labelled rows to learn from, each text once.

    Of all labelled ids outside the held-out fold, the `max_training` first by a hash.
    """
    named = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .filter(crc_fold(F.col("doc_id"), FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    )
    # At most max_training ids and flags.
    texts = id_and_text(docs).join(F.broadcast(named), "doc_id")
    return texts.dropDuplicates(["text"])


def _counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """term, n: documents of `rows` with each term (of `wanted`, if given)."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in slabs(batches, SLAB_BYTES):
            counts: Counter[str] = Counter()
            for text in batch.column(1):
                found = terms_of(set(_WORD.findall(text.as_py().lower())))
                counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["term", "n"],
            )

    counted = rows.select("doc_id", "text").mapInArrow(run, "term string, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def _held_terms(rows: DataFrame, strong: frozenset[str]) -> list[list[str]]:
    """The strong terms of each row; bounded by the rows learned from and MAX_TERMS."""
    shared = rows.sparkSession.sparkContext.broadcast(strong)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strong = shared.value
        for batch in slabs(batches, SLAB_BYTES):
            held = [
                list(terms_of(set(_WORD.findall(text.as_py().lower()))) & strong)
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["terms"])

    found = rows.select("doc_id", "text").mapInArrow(run, "terms array<string>")
    return [row.terms for row in found.collect()]


def strong_terms(
    with_toxic: dict[str, int], with_clean: dict[str, int], n_toxic: int, n_clean: int
) -> dict[str, tuple[float, int, float]]:
    """term -> (weight, clean rows, share) of the terms whose rows are labelled too often for chance."""
    base = n_toxic / (n_toxic + n_clean)
    found = []
    for term, ones in with_toxic.items():
        zeros = with_clean.get(term, 0)
        share = ones / (ones + zeros)
        if share >= 0.8 and _ratio(ones, zeros, share, base) >= _bar(with_toxic):
            weight = math.log((ones + 0.5) / (n_toxic + 1)) - math.log((zeros + 0.5) / (n_clean + 1))
            found.append((_ratio(ones, zeros, share, base), term, weight, zeros, share))
    found.sort(key=lambda x: (-x[0], len(x[1]), x[1]))
    return {term: (weight, zeros, share) for _, term, weight, zeros, share in found[:MAX_TERMS]}


def _bar(candidates) -> float:
    """The ratio that so many candidates do not reach by chance."""
    return math.log(max(2, len(candidates))) + 3


def _ratio(ones: int, zeros: int, share: float, base: float) -> float:
    """Log likelihood ratio of a term's own share of toxic rows against that of all rows."""
    ratio = ones * math.log(share / base)
    return ratio + zeros * math.log((1 - share) / (1 - base)) if zeros else ratio


def choose_terms(
    strong: dict[str, tuple[float, int, float]], rows: list[list[str]], base: float, bar: float
) -> Lexicon:
    """The lexicon from strong terms and, for each toxic row, those that it holds.

    Copies of one row make all its rare words look strong. So a beginning has to reach the bar
    with rows that hold fewer than two terms taken before it. Whole words are taken along where
    a beginning of theirs is, or where they are too short to have one.
    """
    holding: dict[str, list[int]] = {term: [] for term in strong}
    for i, terms in enumerate(rows):
        for term in terms:
            holding[term].append(i)
    covered = np.zeros(len(rows), int)
    beginnings: dict[str, float] = {}
    short: dict[str, float] = {}
    for term, (weight, zeros, share) in strong.items():
        whole = term[0] == "="
        if whole and len(term) > BEGINNINGS.start:
            continue
        if any(term[:size] in beginnings for size in range(BEGINNINGS.start, len(term))):
            continue
        places = [i for i in holding[term] if covered[i] < 2]
        if _ratio(len(places), zeros, share, base) >= bar:
            (short if whole else beginnings)[term.lstrip("=")] = weight
            covered[holding[term]] += 1
    words = {
        term[1:]: weight
        for term, (weight, _, _) in strong.items()
        if term[0] == "=" and any(term[1 : 1 + size] in beginnings for size in BEGINNINGS)
    }
    return Lexicon(beginnings, words | short)


def learn(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Model:
    """The model from the labelled rows outside the held-out fold.

    Without labelled rows of both kinds nothing can be learned: every score is then the share of
    toxic rows, 0 where there is none at all.
    """
    rows = training_rows(docs, labels, max_training).persist()
    try:
        sizes = {row.toxic: row["count"] for row in rows.groupBy("toxic").count().collect()}
        n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
        nothing = Lexicon({}, {})
        if not n_toxic or not n_clean:
            return Model(nothing, 30.0 if n_toxic else -30.0, (0.0,) * len(FEATURES))
        least = max(3, n_toxic // 200)
        toxic = _counted(rows.filter("toxic = 1"), None).filter(F.col("n") >= least)
        # Bounded: the terms that most of the sample's toxic rows hold.
        listed = toxic.orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES).collect()
        with_toxic = {row.term: row.n for row in listed}
        clean = _counted(rows.filter("toxic = 0"), frozenset(with_toxic)).collect()
        strong = strong_terms(with_toxic, {row.term: row.n for row in clean}, n_toxic, n_clean)
        lexicon = choose_terms(
            strong, _held_terms(rows.filter("toxic = 1"), frozenset(strong)),
            n_toxic / (n_toxic + n_clean), _bar(with_toxic),
        )
        shared = rows.sparkSession.sparkContext.broadcast(lexicon)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in slabs(batches, SLAB_BYTES):
                found = [context_features(text.as_py(), matcher) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"]
                )

        # Bounded: one short row for each training row.
        sample = rows.select("doc_id", "text", "toxic").mapInArrow(
            run, "toxic int, features array<double>"
        ).collect()
    finally:
        rows.unpersist()
    empty = [0.0] * len(FEATURES)
    design = np.array([row.features or empty for row in sample])
    bias, weights = _fit(design, np.array([float(row.toxic) for row in sample]))
    return Model(lexicon, bias, weights)


def toxicity_scores(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text has no hit and gets the score of such texts. A row without an id is not
    held out. Repeated rows are answered each, an empty table gives an empty result, and other
    columns (language, source, labels) are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(model.lexicon)
        for batch in slabs(batches, SLAB_BYTES):
            scores = [model.score(context_features(text.as_py(), matcher)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    texts = id_and_text(docs, id_column, text_column)
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        matcher = Matcher(model.lexicon)
        return lambda batch: [
            model.score(context_features(text.as_py(), matcher)) < 0.5 for text in batch.column(1)
        ]

    return rows_where(docs, start, text_column)
