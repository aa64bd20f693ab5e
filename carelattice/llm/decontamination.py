"""Benchmark decontamination with suffix arrays of the training texts.

Each slab of documents is a shard. Its word positions form a suffix array: positions sorted by
the words that follow, to the depth of a window. Every suffix of the test items is searched in
every shard's array by bisection; the ranges found are the places where a window occurs, and
windows that go on in both texts are joined to the longest verbatim matches.

An array leaves out positions that cannot begin a match because one of the next words (as many
as the shortest window has) occurs in no item. Documents stay where they are; only the items,
in blocks of bounded size, are sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, rows_where, slabs
from carelattice.llm.wordarrays import SpanHasher, lower_ascii, word_spans
from carelattice.session import cut_lineage

WINDOW = 10
#: Bytes of item text that one block, and so one broadcast, may hold.
BLOCK_BYTES = 16 << 20

# The bytes words are made of: digits, a-z, and all of a non-ASCII letter.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = True
_INSIDE[0x61:0x7B] = True
_INSIDE[0x80:] = True


def words_of(flat: np.ndarray, borders: np.ndarray, hasher: SpanHasher):
    """Folded bytes, word starts and ends, word hashes, and each text's first word (n+1)."""
    folded = lower_ascii(flat)
    starts, ends = word_spans(folded, borders, _INSIDE)
    return folded, starts, ends, hasher(folded, starts, ends), np.searchsorted(starts, borders)


class TestSet:
    """The suffixes of the items' words, each with its window."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.window = window
        flat = np.frombuffer("".join(text for _, text in items).encode(), np.uint8)
        sizes = [len(text.encode()) for _, text in items]
        borders = np.append(0, np.cumsum(sizes)).astype(np.int64)
        folded, starts, ends, hashes, first = words_of(flat, borders, SpanHasher())
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.uint32) + 1  # 0 is any word outside the items
        self.words = [
            folded[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        ]
        counts = np.diff(first)
        lengths = np.minimum(counts, window)
        windows = np.where(counts > 0, counts - lengths + 1, 0)
        self.item = np.repeat(np.arange(len(items)), windows)
        self.start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.length = lengths[self.item]
        self.at = first[self.item] + self.start  # in self.words
        keys = np.zeros((len(self.item), window), np.uint32)
        for k in range(window):
            held = self.length > k
            keys[held, k] = ids[self.at[held] + k]
        self.low = packed(keys)
        keys[np.arange(window)[None, :] >= self.length[:, None]] = 0xFFFFFFFF
        self.high = packed(keys)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        self.names = [name for name, _ in items]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 if no item has it."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


def packed(keys: np.ndarray) -> list[np.ndarray]:
    """Columns of word numbers, two in each 64-bit column, first column first."""
    if keys.shape[1] % 2:
        keys = np.concatenate([keys, np.zeros((len(keys), 1), np.uint32)], 1)
    wide = keys.astype(np.uint64)
    return [wide[:, k] << np.uint64(32) | wide[:, k + 1] for k in range(0, wide.shape[1], 2)]


def suffix_array(ids: np.ndarray, ends: np.ndarray, window: int, shortest: int):
    """Word positions in the order of the `window` words that follow, and their key columns.

    ends[i]: where the text of word i ends. A key stops (zeros follow) at the text's end and at
    the first word outside the items; positions whose key has under `shortest` words are left out.
    """
    n = len(ids)
    # How many words from here on are in the items: distance to the next one that is not.
    stops = np.where(ids == 0, np.arange(n), n)
    next_stop = np.minimum.accumulate(stops[::-1])[::-1] if n else stops
    run = np.minimum(next_stop, ends) - np.arange(n)
    positions = np.flatnonzero(run >= max(1, shortest))
    run = np.minimum(run[positions], window)
    keys = np.zeros((len(positions), window), np.uint32)
    for k in range(window):
        held = run > k
        keys[held, k] = ids[positions[held] + k]
    columns = packed(keys)
    order = np.lexsort(columns[::-1])
    return positions[order], [column[order] for column in columns]


def bisect(columns: list[np.ndarray], sought: list[np.ndarray], after: bool) -> np.ndarray:
    """Where each sought key stands among sorted keys of several columns."""
    count = len(sought[0])
    low, high = np.zeros(count, np.int64), np.full(count, len(columns[0]), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        probe = np.minimum(middle, len(columns[0]) - 1)
        less = np.zeros(count, bool)
        equal = np.ones(count, bool)
        for column, key in zip(columns, sought, strict=True):
            held = column[probe]
            less |= equal & (held < key)
            equal &= held == key
        less |= equal & after
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def _matches(test: TestSet, folded, starts, ends, hashes, first):
    """Longest verbatim matches in one shard: text, item, item_start, doc_start, n_words."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(starts) or not len(test.item):
        return nothing
    text_ends = np.repeat(first[1:], np.diff(first))
    positions, columns = suffix_array(test.ids(hashes), text_ends, test.window, test.shortest)
    if not len(positions):
        return nothing
    low, high = bisect(columns, test.low, False), bisect(columns, test.high, True)
    found = high - low
    suffix = np.repeat(np.arange(len(found)), found)
    places = positions[
        np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    ]
    # Word hashes led here; the bytes decide.
    exact = np.array(
        [
            all(
                test.words[a + k] == folded[starts[p + k] : ends[p + k]].tobytes() for k in range(m)
            )
            for a, p, m in zip(
                test.at[suffix].tolist(), places.tolist(), test.length[suffix].tolist(), strict=True
            )
        ],
        bool,
    )
    suffix, places = suffix[exact], places[exact]
    if not len(suffix):
        return nothing
    # Windows that follow each other in both texts are one match.
    item, at, size = test.item[suffix], test.start[suffix], test.length[suffix]
    order = np.lexsort((places, places - at, item))
    item, at, size, places = item[order], at[order], size[order], places[order]
    text = np.searchsorted(first, places, side="right") - 1
    new = np.ones(len(item), bool)
    new[1:] = (
        (item[1:] != item[:-1]) | (places[1:] - at[1:] != places[:-1] - at[:-1])
        | (places[1:] != places[:-1] + 1) | (text[1:] != text[:-1])
    )
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(item)) - 1
    return (
        text[begin], item[begin], at[begin], places[begin] - first[text[begin]],
        places[last] - places[begin] + size[last],
    )


_MATCH = "struct<item_id: {kind}, item_start: bigint, doc_start: bigint, n_words: bigint>"


def _in_block(docs: DataFrame, items: list[tuple[object, str]], item_kind: str, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    name_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    struct = pa.struct(
        [("item_id", name_type), *((n, pa.int64()) for n in ("item_start", "doc_start", "n_words"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, hasher = TestSet(shared.value, window), SpanHasher()
        for batch in slabs(batches, 4 << 20):
            flat, borders = flat_bytes(batch.column(1))
            folded, starts, ends, hashes, first = words_of(flat, borders, hasher)
            text, item, *rest = _matches(test, folded, starts, ends, hashes, first)
            order = np.lexsort((rest[1], text))
            borders = np.searchsorted(text[order], np.arange(batch.num_rows + 1))
            names = [test.names[i] for i in item[order].tolist()]
            values = pa.StructArray.from_arrays(
                [pa.array(names, name_type), *(pa.array(column[order]) for column in rest)],
                fields=list(struct),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), values),
                ],
                ["doc_id", "n_words", "matches"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, matches array<{_MATCH.format(kind=item_kind)}>"
    )


def _item_blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int):
    """The items to search for, the type of their ids, and in how many blocks they are sent."""
    items = (
        benchmark.select(F.col(item_column).alias("item_id"), F.col(text_column).alias("text"))
        .dropna()
        .distinct()
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, dict(items.dtypes)["item_id"], max(1, math.ceil(size / block_bytes))


def _listed(items: DataFrame, block: int, blocks: int) -> list[tuple[object, str]]:
    """The items of one block; bounded by the size of a block."""
    held = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
    return [(row.item_id, row.text) for row in held.collect()]


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, matches (item_id, item_start, doc_start, n_words) of every row of `docs`.

    A match is a stretch of words, A-Z lower-cased, that a document and an item share: at least
    `window` words, or all words of an item that has fewer. A null text has no words; an item
    without words or without an id is not searched for; rows that repeat an item add nothing.
    Every row of `docs` is a document, whether its id is repeated or missing, however many blocks
    the items take. Empty tables give no rows, or documents without matches. Other columns are not read.
    """
    texts = id_and_text(docs, id_column, text_column)
    items, item_kind, blocks = _item_blocks(benchmark, item_column, item_text_column, block_bytes)
    if blocks > 1:
        # A row's number holds its results of all blocks together; it stands in place of the id.
        numbered = texts.withColumn("row", F.monotonically_increasing_id())
        numbered = cut_lineage(numbered, "numbered-documents")
        names = numbered.select("row", F.col("doc_id").alias("name"))
        texts = numbered.select(F.col("row").alias("doc_id"), "text")
    results = []
    for block in range(blocks):
        listed = _listed(items, block, blocks)
        results.append(_in_block(texts, listed, item_kind, window))
    if blocks == 1:
        return results[0]
    together = results[0]
    for further in results[1:]:
        together = together.unionByName(further)
    held = together.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")
    )
    return names.join(held, "row").select(F.col("name").alias("doc_id"), "n_words", "matches")


def contamination(matches: DataFrame) -> DataFrame:
    """Per document the words hit, the items that hit them, and whether there are any."""
    hit = """aggregate(
        array_sort(transform(matches, m -> struct(m.doc_start as s, m.doc_start + m.n_words as e))),
        named_struct('hit', 0L, 'last', 0L),
        (a, x) -> named_struct(
            'hit', a.hit + greatest(0L, x.e - greatest(a.last, x.s)), 'last', greatest(a.last, x.e)),
        a -> a.hit)"""
    items = "array_sort(array_distinct(transform(matches, m -> cast(m.item_id as string))))"
    return matches.select(
        "doc_id", "n_words", F.expr(hit).alias("n_hit"),
        F.expr(f"cast(size({items}) as bigint)").alias("n_items"),
        F.sha2(F.expr(f"array_join({items}, ',')"), 256).alias("items_sha256"),
        F.expr("size(matches) > 0").alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of any item occurs."""
    items, _, blocks = _item_blocks(benchmark, item_column, item_text_column, block_bytes)
    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(_listed(items, block, blocks))

        def start(shared=shared):
            test, hasher = TestSet(shared.value, window), SpanHasher()

            def clean(batch: pa.RecordBatch) -> np.ndarray:
                hit = _matches(test, *words_of(*flat_bytes(batch.column(1)), hasher))[0]
                flags = np.ones(batch.num_rows, bool)
                flags[hit] = False
                return flags

            return clean

        docs = rows_where(docs, start, text_column)
    return docs
