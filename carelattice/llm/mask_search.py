"""Ranked lexical search: documents of an item grouped by the mask of the item's terms they hold.

First every document is cut into terms once; how often it holds each term that any item asks for is
written as its postings, and the counts of the corpus (documents, terms, documents of each term) are
summed over them. Then each item is met with all postings, slab by slab: a bit for each distinct term of
the item is set in the masks of the term's documents, documents with equal masks form a group, and a
group's greatest possible score is the sum, over the bits set, of what the term gives at most in this
slab. Groups are scored exactly in descending order of that bound, until the bound falls below the
score of the item's current k-th best document. A task carries its k best documents of each item from
slab to slab, so that most groups are never scored, and returns only them.

Items are a stated set of queries against all rows. They go to the tasks in blocks of bounded bytes;
a block has its own postings, and results don't depend on how items are dealt out to blocks. Documents
are never shuffled: only counts by term, and each task's best documents, are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs
from carelattice.session import cut_lineage

#: Documents returned for an item.
BEST = 10
#: Bytes of item texts in a block, which is broadcast; and postings met at once.
BLOCK_BYTES = 4 << 20
SLAB_POSTINGS = 400_000
#: Documents scored at once, of the groups next in order.
_TOGETHER = 64
#: Parts that the best documents of an item are dealt into before the last choice.
_PARTS = 64
# Terms are the runs of ASCII letters and digits and of everything beyond ASCII; in UTF-8 the same as:
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_POSTINGS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in order; only A-Z are lower-cased."""
    return _TERM.findall(text.lower())


def term_weight(holding: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Items:
    """The items of a block: their distinct terms, as numbers, and how often each asks for them."""

    def __init__(self, rows: list[tuple[object, list[str]]]):
        self.ids = [item for item, _ in rows]
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.repeats: list[np.ndarray] = []
        for _, texts in rows:
            asked = Counter(term for text in texts for term in terms_of(text.encode()))
            numbers = [self.number.setdefault(term, len(self.number)) for term in asked]
            self.terms.append(np.array(numbers, np.int64))
            self.repeats.append(np.array(list(asked.values()), np.int64))


def _blocks(items: DataFrame, item_column: str, text_column: str, block_bytes: int) -> Iterator[Items]:
    """The items in blocks. Rows of one item are one item, equal rows once; null asks for nothing."""
    rows = items.select(F.col(item_column).alias("item_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    listed = cut_lineage(
        rows.distinct().groupBy("item_id").agg(F.collect_list("text").alias("texts"))
        .withColumn("bytes", F.expr("aggregate(texts, 16L, (n, t) -> n + octet_length(t))")),
        "search-items",
    )
    held: list[tuple[object, list[str]]] = []
    size = 0
    # One partition of the items after another comes to the driver, never all of them.
    for row in listed.toLocalIterator():
        if held and size + row["bytes"] > block_bytes:
            yield Items(held)
            held, size = [], 0
        held.append((row["item_id"], row["texts"]))
        size += row["bytes"]
    if held:
        yield Items(held)


def _postings(docs: DataFrame, block: Items) -> DataFrame:
    """doc_id, n, terms, counts of every document: n counts all its terms, the others are the block's."""
    shared = docs.sparkSession.sparkContext.broadcast(block.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in slabs(batches, 1 << 20):
            flat, borders = flat_bytes(batch.column(1))
            view = memoryview(flat)
            sizes, terms, counts, at = [], [], [], [0]
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                found = terms_of(bytes(view[a:b]))
                held = Counter(filter(number.__contains__, found))
                sizes.append(len(found))
                terms += map(number.__getitem__, held)
                counts += held.values()
                at.append(len(terms))
            borders = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(borders, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(borders, pa.array(counts, pa.int64()))],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.mapInArrow(run, _POSTINGS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the n+1 borders of its rows."""
    borders = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[borders[0] : borders[-1]], borders - borders[0]


def _postings_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, borders = _flat(batch.column(2))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(borders, borders[start] + SLAB_POSTINGS, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def _masks(members: list[np.ndarray], documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents that hold any term, the distinct masks (rows of bits), and each document's mask."""
    words = -(-len(members) // 64)
    masks = np.zeros((words, documents), np.uint64)
    for bit, holding in enumerate(members):
        masks[bit // 64][holding] |= np.uint64(1 << bit % 64)
    held = np.flatnonzero(masks.any(0))
    masks = masks[:, held]
    group = np.zeros(len(held), np.int64)
    for word in masks:
        # Word by word: documents are alike if they were so far and have this word in common.
        _, here = np.unique(word, return_inverse=True)
        _, group = np.unique(group * (int(here.max(initial=0)) + 1) + here, return_inverse=True)
    _, first = np.unique(group, return_index=True)
    distinct = np.ascontiguousarray(masks[:, first].T)
    bits = np.unpackbits(distinct.view(np.uint8), axis=1, bitorder="little")[:, : len(members)]
    return held, bits, group


class Search:
    """The k best documents of each item so far; met with slabs of postings."""

    def __init__(self, block: Items, weights: np.ndarray, documents: int, total: int, best: int):
        self.block, self.weights, self.documents, self.total, self.best = block, weights, documents, total, best
        empty = np.zeros(0, np.int64)
        # Scores, documents and whether the document has an id.
        self.found = [(empty, empty, np.zeros(0, bool)) for _ in block.ids]
        self.asked = np.zeros(len(block.number), np.int64)

    def meet(self, ids: np.ndarray, named: np.ndarray, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, at: np.ndarray) -> None:
        documents = len(ids)
        # Whole numbers of any size where 64 bits could overflow.
        sizes = n.astype(object) if int(n.max()) * self.documents >= 1 << 56 else n
        m = 100 - 75 + ((75 * sizes * self.documents) // self.total).astype(np.int64)
        owner = np.repeat(np.arange(documents), np.diff(at))
        part = (1_000_000_000 * counts) // (1000 * counts + 8 * m[owner])
        order = np.argsort(terms, kind="stable")
        here, first = np.unique(terms[order], return_index=True)
        ends = np.append(first[1:], len(order))
        holding = owner[order]
        most = np.maximum.reduceat(part[order], first) if len(first) else np.zeros(0, np.int64)
        for item in range(len(self.block.ids)):
            wanted = self.block.terms[item]
            spot = np.minimum(np.searchsorted(here, wanted), max(len(here) - 1, 0))
            present = here[spot] == wanted if len(here) else np.zeros(len(wanted), bool)
            if not present.any():
                continue
            wanted, spot = wanted[present], spot[present]
            gives = self.weights[wanted] * self.block.repeats[item][present]
            scores = self.found[item][0]
            floor = int(scores[-1]) if len(scores) == self.best else 1
            if int((gives * most[spot]).sum()) < floor:
                continue
            held, bits, group = _masks([holding[first[s] : ends[s]] for s in spot.tolist()], documents)
            bounds = bits.astype(np.int64) @ (gives * most[spot])
            ranked = np.argsort(-bounds, kind="stable")
            members = np.argsort(group, kind="stable")
            size = np.bincount(group)
            begins = np.cumsum(size) - size
            self.asked[wanted] = gives
            done = 0
            while done < len(ranked):
                scores = self.found[item][0]
                floor = int(scores[-1]) if len(scores) == self.best else 1
                if bounds[ranked[done]] < floor:
                    break
                upto = done + 1 + int(np.searchsorted(np.cumsum(size[ranked[done:]]), _TOGETHER))
                next_groups = ranked[done : min(upto, len(ranked))]
                next_groups = next_groups[bounds[next_groups] >= floor]
                chosen = held[np.concatenate([members[begins[g] : begins[g] + size[g]] for g in next_groups.tolist()])]
                self._score(item, chosen, ids, named, terms, part, at)
                done += len(next_groups)
            self.asked[wanted] = 0

    def _score(self, item: int, chosen, ids, named, terms, part, at) -> None:
        sizes = at[chosen + 1] - at[chosen]
        borders = np.cumsum(sizes) - sizes
        places = np.repeat(at[chosen] - borders, sizes) + np.arange(int(sizes.sum()))
        scores = np.add.reduceat(self.asked[terms[places]] * part[places], borders)
        positive = scores > 0
        old = self.found[item]
        new = scores[positive], ids[chosen[positive]], named[chosen[positive]]
        scores, doc, has = (np.concatenate(pair) for pair in zip(old, new, strict=True))
        top = np.lexsort((doc, ~has, -scores))[: self.best]
        self.found[item] = scores[top], doc[top], has[top]


def _best_of_tasks(postings: DataFrame, block: Items, weights: np.ndarray, counts: tuple[int, int], best: int) -> DataFrame:
    """item, doc_id, score: the best documents of each task's postings."""
    shared = postings.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own = shared.value
        search = Search(items, own, *counts, best)
        for batch in _postings_slabs(batches):
            names = batch.column(0)
            terms, at = _flat(batch.column(2))
            search.meet(
                names.fill_null(0).to_numpy(), names.is_valid().to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(), terms, _flat(batch.column(3))[0], at,
            )
        item = np.repeat(np.arange(len(search.found)), [len(found[0]) for found in search.found])
        none = np.zeros(0, np.int64)
        score, doc = (np.concatenate([none, *(found[k] for found in search.found)]) for k in (0, 1))
        unnamed = ~np.concatenate([np.zeros(0, bool), *(found[2] for found in search.found)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=unnamed), pa.array(score, pa.int64())],
            ["item", "doc_id", "score"],
        )

    return postings.filter("size(terms) > 0").mapInArrow(run, "item int, doc_id bigint, score bigint")


def _first_ranks(found: DataFrame, key: list[str], best: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `best` documents of a score above 0.

    Of equal scores the smaller doc_id comes first, and no id last. Every row of `docs` is a document, so
    rows of one id or without an id are ranked each; null and empty texts hold no term. Rows of one
    item_id are one item that asks for the terms of all of them, equal rows once. An item of which no
    document holds a term has no row, as has everything where either table is empty. Other columns are
    not read. A text is cut into terms by one task, with memory in proportion to its length.
    """
    texts = id_and_text(docs, id_column, text_column)
    kind = dict(items.dtypes)[item_column]
    spark = docs.sparkSession
    corpus: tuple[int, int] | None = None
    results = []
    for block in _blocks(items, item_column, item_text_column, block_bytes):
        postings = cut_lineage(_postings(texts.withColumn("doc_id", F.col("doc_id").cast("bigint")), block), "postings")
        if corpus is None:
            row = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
            corpus = row[0], row[1] or 0
        if not corpus[0]:
            break
        # A count for each term of the block at most.
        held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        weights = np.zeros(len(block.number), np.int64)
        for term, holding in zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True):
            weights[term] = term_weight(holding, corpus[0])
        found = _best_of_tasks(postings, block, weights, corpus, best)
        # Many tasks' best of one item: first within parts, then all.
        parted = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)))
        ranked = _first_ranks(_first_ranks(parted, ["item", "part"], best).drop("rank", "part"), ["item"], best)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        results.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, results)
