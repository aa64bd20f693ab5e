"""Near-duplicates by SimHash and a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments, and each segment is replaced by its number of set
bits. Bits that differ change counts by at most as much: the Manhattan distance of two count
vectors is a lower bound of the Hamming distance of the fingerprints. The range join runs on a
grid over the counts: segments are put in eight groups, and counts within a distance of 4 agree in
at least four groups altogether, so vectors meet in the cells of the 70 grids over four groups.
Within a cell the Manhattan distance is tested first, then the fingerprints themselves.

Counts are kept in unary, i.e. as segments with their bits sorted: Manhattan distance of counts
then is the Hamming distance of these codes, one XOR and one popcount.

Equal fingerprints are one node, so copies never meet. A pair that shares several cells is taken
from the first only; a cell of many nodes gives a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs
from carelattice.llm.wordarrays import SpanHasher, lower_ascii, mixed, word_spans
from carelattice.operators.identity import connected_components
from carelattice.session import cut_lineage

WORDS = 4
DISTANCE = 4
SEED = 42
#: Words of the shingles that `similar_documents` compares, and their Jaccard similarity.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Documents and shingles of the sample that says which shingles are frequent. It sets the order of
#: the shingles only; pairs are complete in any order.
_SAMPLE = 4_000
_FREQUENT = 200_000
_GROUPS = 8
#: The grids: four of the eight groups each.
_GRIDS = list(combinations(range(_GROUPS), _GROUPS - DISTANCE))
#: Cells of more nodes give a spanning forest instead of single pairs.
_SMALL_CELL = 24
_SHINGLES = 200_000
#: 64-bit words of a text's parity sketch, and texts sketched at once.
_SKETCH = 32
_SKETCHED = 512
#: Bits of the map of wanted ids, which is broadcast: at most 65,536 rows.
_MARKS = 1 << 22
#: Bytes of text whose shingles are held at once.
_SLAB = 512 << 10
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words are parted by ASCII white space.
_INSIDE = np.ones(256, bool)
_INSIDE[[*b"\t\n\v\f\r "]] = False


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, with `counts` of the hashes each: the bits set in over half of them."""
    prints = np.zeros(len(counts), np.uint64)
    held = np.flatnonzero(counts)
    borders = np.append(0, np.cumsum(counts[held]))
    start = 0
    while start < len(held):
        end = int(np.searchsorted(borders, borders[start] + _SHINGLES, side="right")) - 1
        end = min(max(end, start + 1), len(held))
        part = hashes[borders[start] : borders[end]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, borders[start:end] - borders[start], axis=0, dtype=np.int32)
        over = 2 * sums > counts[held[start:end], None]
        prints[held[start:end]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
        start = end
    return prints


def _text_prints(flat: np.ndarray, borders: np.ndarray, words: int) -> np.ndarray:
    view = memoryview(flat)
    hash_of = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(borders) - 1, np.int64)
    for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
        parts = bytes(view[a:b]).lower().split()  # bytes: A-Z only, and ASCII white space
        if not parts:
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        taken = min(words, len(parts))
        starts = np.append(0, ends[: len(parts) - taken] + 1)
        counts[i] = len(starts)
        hashes += [
            hash_of(joined[s:e], SEED)
            for s, e in zip(starts.tolist(), ends[taken - 1 :].tolist(), strict=True)
        ]
    return _majority(np.array(hashes, np.uint64), counts)


def fingerprints(
    docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (64 bits as a signed number) of every row; zero for no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, _SLAB):
            prints = _text_prints(*flat_bytes(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"]
            )

    texts = id_and_text(docs, id_column, text_column)
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def unary_counts(prints: np.ndarray) -> np.ndarray:
    """Segments of two bits with their bits sorted: 00, 01 or 11 for a count of 0, 1 or 2."""
    low = np.uint64(0x5555555555555555)
    beside = prints >> np.uint64(1)
    return ((prints | beside) & low) | (((prints & beside) & low) << np.uint64(1))


def _cells(counts: np.ndarray, grid: int) -> np.ndarray:
    """The cell of each count vector in a grid: the grid's number and the counts of its groups."""
    groups = counts.view(np.uint8).reshape(-1, _GROUPS)
    cell = np.full(len(counts), grid, np.int64)
    for group in _GRIDS[grid]:
        cell = cell << 8 | groups[:, group]
    return cell


def _first_grid() -> np.ndarray:
    """By the flags of agreeing groups: the first grid that a pair meets in."""
    first = np.full(256, -1, np.int64)
    for grid in range(len(_GRIDS) - 1, -1, -1):
        needed = sum(1 << group for group in _GRIDS[grid])
        first[[flags for flags in range(256) if flags & needed == needed]] = grid
    return first


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    same = (left ^ right).view(np.uint8).reshape(-1, _GROUPS) == 0
    return np.packbits(same, axis=1, bitorder="little")[:, 0]


def _linked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """First the lower bound on the counts, then the fingerprints."""
    near = np.bitwise_count(unary_counts(left) ^ unary_counts(right)) <= DISTANCE
    near[near] = np.bitwise_count(left[near] ^ right[near]) <= DISTANCE
    return near


def _forest(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the nodes of a large cell.

    Linked nodes agree in one of five blocks of their bits, so they are compared block by block;
    a node is compared only with nodes that it is not joined with yet.
    """
    leader = np.arange(len(nodes))
    lefts, rights = [], []

    def root(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    cuts = [0, 13, 26, 39, 52, 64]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        block = (nodes >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(block, kind="stable")
        borders = np.flatnonzero(np.diff(block[order].astype(np.int64), prepend=-1, append=-1))
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            members = order[a:b]
            while len(members) > 1:
                one, members = members[0], members[1:]
                found = members[_linked(np.full(len(members), nodes[one]), nodes[members])]
                for other in found.tolist():
                    x, y = root(one), root(other)
                    if x != y:
                        leader[max(x, y)] = min(x, y)
                        lefts.append(one)
                        rights.append(other)
    return nodes[np.array(lefts, np.int64)], nodes[np.array(rights, np.int64)]


def _cell_links(cells: np.ndarray, nodes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the nodes of each cell; rows are sorted by cell and cells are whole."""
    lefts, rights = [], []
    borders = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
    sizes = np.diff(borders)
    keep = np.repeat((sizes > 1) & (sizes <= _SMALL_CELL), sizes)
    cell, node = cells[keep], nodes[keep]
    for apart in range(1, _SMALL_CELL):
        at = np.flatnonzero(cell[apart:] == cell[:-apart])
        if not len(at):
            break
        left, right = node[at], node[at + apart]
        chosen = _linked(left, right)
        left, right, grid = left[chosen], right[chosen], cell[at][chosen] >> 32
        once = first[_agreeing(unary_counts(left), unary_counts(right))] == grid
        lefts.append(left[once])
        rights.append(right[once])
    for i in np.flatnonzero(sizes > _SMALL_CELL):
        left, right = _forest(nodes[borders[i] : borders[i + 1]])
        lefts.append(left)
        rights.append(right)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def near_links(prints: DataFrame) -> DataFrame:
    """id, lead_id: fingerprints that differ in at most DISTANCE bits, enough of these links to
    connect all that are connected. `prints` has distinct values of `fingerprint`."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy().view(np.uint64)
            counts = unary_counts(nodes)
            for grid in range(len(_GRIDS)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_cells(counts, grid)), batch.column(0)], ["cell", "fingerprint"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _first_grid()
        cells, nodes = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(cells: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            left, right = _cell_links(cells, nodes, first)
            return pa.RecordBatch.from_arrays(
                [pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["id", "lead_id"]
            )

        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            nodes = np.concatenate([nodes, batch.column(1).to_numpy().view(np.uint64)])
            # The last cell may go on in the next batch.
            cut = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
            yield links(cells[:cut], nodes[:cut])
            cells, nodes = cells[cut:], nodes[cut:]
        yield links(cells, nodes)

    met = (
        prints.select("fingerprint").mapInArrow(spread, "cell bigint, fingerprint bigint")
        .repartition("cell").sortWithinPartitions("cell")
    )
    return met.mapInArrow(meet, "id bigint, lead_id bigint").distinct()


def near_duplicates(
    docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    `component_id` is the smallest id reachable over links of at most 4 differing bits. Null and
    empty texts have the fingerprint zero, which links like any other. Rows without an id take
    part without naming a component; one of them alone has a null component. Repeated rows are
    answered each; an empty table gives an empty result; other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, words, id_column, text_column), "fingerprints")
    nodes = cut_lineage(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "print-nodes"
    )
    components = connected_components(near_links(nodes)).select(
        F.col("id").alias("fingerprint"), "component"
    )
    named = nodes.join(components, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answers = cut_lineage(
        named.join(smallest, "component").select("fingerprint", "component_id"), "components"
    )
    return prints.join(answers, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _shingles(column: pa.Array, words: int, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct word shingles, sorted by text and hash; a text with fewer
    than `words` words has one, of them all."""
    flat, borders = flat_bytes(column)
    flat = lower_ascii(flat)
    starts, ends = word_spans(flat, borders, _INSIDE)
    hashes = np.append(hasher(flat, starts, ends), np.zeros(words, np.uint64))
    first = np.searchsorted(starts, borders)
    sizes = np.diff(first)
    counts = np.where(sizes > 0, np.maximum(1, sizes - words + 1), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    at = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(len(text))
    held = np.minimum(sizes, words)[text]
    grams = held.astype(np.uint64)
    for j in range(words):
        grams = np.where(j < held, grams * _MULTIPLIER + hashes[at + j], grams)
    grams = mixed(grams, np.zeros(1, np.uint64))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    once = np.ones(len(grams), bool)
    once[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[once], text[once]


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample hold, in ascending order, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in slabs(batches, _SLAB):
            grams, _ = _shingles(batch.column(1), words, hasher)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["shingle"])

    apart = max(1, texts.count() // _SAMPLE)
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(apart)) == 0)
    found = (
        sample.mapInArrow(run, "shingle bigint").groupBy("shingle").count().filter("count > 2")
        .orderBy(F.desc("count"), "shingle").limit(_FREQUENT).toArrow()
    )
    shingles = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found.column("count").to_numpy().astype(np.int64)[order]


def _prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """shingle, doc_id, place, size: the first shingles of each text in an order that all texts share,
    seldom ones first. Texts that are similar have one of these in common."""
    known, counts = _frequent(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in slabs(batches, _SLAB):
            grams, text = _shingles(batch.column(1), words, hasher)
            often = np.zeros(len(grams), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                often = np.where(known[at] == grams, counts[at], 0)
            order = np.lexsort((grams, often, text))  # keeps the texts together
            grams = grams[order]
            sizes = np.bincount(text, minlength=batch.num_rows)
            place = np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[text]
            # A similar text has at least this share of the shingles in common.
            taken = place <= sizes[text] - np.ceil(similarity * sizes[text] - 1e-6)
            ids = batch.column(0).to_numpy()[text[taken]].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[taken].view(np.int64)), pa.array(ids), pa.array(place[taken].astype(np.int32)),
                 pa.array(sizes[text[taken]].astype(np.int32))],
                ["shingle", "doc_id", "place", "size"],
            )

    return texts.mapInArrow(run, "shingle bigint, doc_id bigint, place int, size int")


def _shared(firsts: DataFrame) -> DataFrame:
    """The rows of shingles that several texts have among their first ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, end = None, None  # the last row read, and the shingle of the last one given out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            shingles = rows.column(0).to_numpy()
            same = shingles[1:] == shingles[:-1]
            keep = np.append(False, same) | np.append(same, False)
            keep[0] |= end is not None and shingles[0] == end
            # Of the last row it isn't known yet whether the next has the same shingle.
            held = rows.slice(len(shingles) - 1).to_batches()[0]
            end = shingles[-1] if keep[-1] else None
            yield from rows.slice(0, len(shingles) - 1).filter(pa.array(keep[:-1])).to_batches()
        if held is not None and end is not None:
            yield held

    dealt = firsts.repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(run, firsts.schema)


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, sketch of every text: a bit for each bucket of hashes, set if it has an odd number of the
    text's shingles. Sets differ in at least as many shingles as their sketches in bits."""
    bits = 64 * _SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in slabs(batches, _SLAB, _SKETCHED):
            grams, text = _shingles(batch.column(1), words, hasher)
            bucket = text * bits + (grams % np.uint64(bits)).astype(np.int64)
            odd = np.bincount(bucket, minlength=bits * batch.num_rows) & 1
            held = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
            borders = np.arange(0, _SKETCH * batch.num_rows + 1, _SKETCH, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(borders), pa.array(held))], ["doc_id", "sketch"]
            )

    return texts.mapInArrow(run, "doc_id bigint, sketch array<bigint>")


def _mostly_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted texts and, where very many are wanted, some others: ids are marked in a bitmap of `_MARKS`
    bits, so that a join shuffles few texts that it does not need, however many ids there are."""
    mark = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(_MARKS))
    word = lambda: F.shiftright(mark(), 6).cast("int").alias("_word")
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(mark(), F.lit(64)).cast("int"))
    marked = wanted.groupBy(word()).agg(F.bit_or(bit()).alias("_bits"))
    return (
        texts.withColumn("_word", word()).join(F.broadcast(marked), "_word")
        .filter(F.col("_bits").bitwiseAND(bit()) != 0).select("doc_id", "text")
    )


def _both_sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    side = lambda name, alias: values.select(
        F.col("doc_id").alias(name), F.col(column).alias(alias)
    )
    return pairs.join(side("id", "own"), "id").join(side("lead_id", "other"), "lead_id").select(
        *pairs.columns, "own", "other"
    )


def _may_be_similar(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (id, lead_id, sizes) but those whose sketches show that they differ too much."""
    differing = F.aggregate(
        F.zip_with("own", "other", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, more: n + more
    )
    most = (1 - similarity) / (1 + similarity) * F.col("sizes") + 1e-6
    return _both_sides(pairs, sketches, "sketch").filter(differing <= most).select("id", "lead_id")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (id, lead_id) whose shingles are similar by Jaccard. Texts meet and not their shingles, which
    are longer and do not compress."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in slabs(batches, _SLAB):
            (own, own_row), (other, other_row) = (_shingles(batch.column(i), words, hasher) for i in (1, 2))
            grams, row = np.append(own, other), np.append(own_row, other_row)
            sizes = np.bincount(row, minlength=batch.num_rows)
            order = np.lexsort((grams, row))
            grams, row = grams[order], row[order]
            twice = (grams[1:] == grams[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][twice], minlength=batch.num_rows)
            keep = pa.array(common >= similarity * (sizes - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["id", "lead_id"]).filter(keep)

    both = _both_sides(pairs, texts, "text").select("id", "own", "other", "lead_id")
    return both.mapInArrow(run, "id bigint, lead_id bigint")


def _free_shuffles(spark: SparkSession) -> None:
    """Let the driver forget what no result needs any more: Spark then deletes those steps' shuffle files,
    which would otherwise stay on disk until the driver's memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(
        F.col("id").alias("doc_id"), F.col("component").alias("component_id")
    )


def similar_documents(
    docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, component_id of the documents that have a near-duplicate.

    Documents link if their fingerprints (as in `near_duplicates`) differ in at most 4 bits, or
    if their shingles of `words` words have a Jaccard similarity of `similarity` or more;
    `component_id` is the smallest id reachable. Both rules are exact, whatever the edits' shape.

    Documents that hold the same shingle among their first ones (`_prefixes`) form a group. In each
    round a group has some leads, which are compared with all its members of other components, and
    leave it; a group goes when its members are of one component. So a pair that is never
    compared is in one component already. Rows without an id take no part; an empty table
    gives an empty result.
    """
    texts = id_and_text(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    texts = texts.filter("doc_id is not null")
    labels = cut_lineage(
        near_duplicates(texts).filter("doc_id != component_id").select("doc_id", "component_id").distinct(),
        "near-labels",
    )
    # The cells of the fingerprints are as large as what follows.
    _free_shuffles(docs.sparkSession)
    members = _shared(_prefixes(texts, words, similarity))
    sketches, tried, leads_each = None, None, 1
    while True:
        members = cut_lineage(
            members.join(labels, "doc_id", "left").select(
                "shingle", "doc_id", "place", "size", F.coalesce("component_id", "doc_id").alias("component")
            ),
            "members",
        )
        open_groups = members.groupBy("shingle").agg(
            F.min("component").alias("a"), F.max("component").alias("b")
        ).filter("a != b").select("shingle")
        members = cut_lineage(members.join(open_groups, "shingle"), "open-members")
        del open_groups
        _free_shuffles(docs.sparkSession)
        if members.isEmpty():
            return labels.unionByName(labels.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
        if sketches is None:
            # Of all texts: which ones are wanted would take a shuffle of the texts to find.
            sketches = cut_lineage(_sketches(texts, words).dropDuplicates(["doc_id"]), "sketches")
        leads = cut_lineage(
            members.groupBy("shingle", F.pmod(F.xxhash64("doc_id"), F.lit(leads_each)).alias("part"))
            .agg(*(F.min_by(c, "doc_id").alias(f"lead_{c}") for c in ("doc_id", "place", "size", "component")))
            .drop("part"),
            "leads",
        )
        # All that the two can share from here on, as this is their first common shingle or a later one.
        shared = F.least(F.col("size") - F.col("place"), F.col("lead_size") - F.col("lead_place"))
        pairs = (
            members.join(leads, "shingle")
            .filter("component != lead_component")
            .filter(shared >= similarity * (F.col("size") + F.col("lead_size") - shared) - 1e-6)
            .select(F.greatest("doc_id", "lead_doc_id").alias("id"), F.least("doc_id", "lead_doc_id").alias("lead_id"),
                    (F.col("size") + F.col("lead_size")).alias("sizes"))
            .distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["id", "lead_id"], "left_anti")
        pairs = cut_lineage(pairs, "similar-pairs")
        own = pairs.select("id", "lead_id")
        tried = own if tried is None else tried.unionByName(own)
        close = cut_lineage(_may_be_similar(pairs, sketches, similarity), "close-pairs")
        wanted = cut_lineage(close.select(F.explode(F.array("id", "lead_id")).alias("doc_id")).distinct(), "compared")
        links = cut_lineage(_verified(close, _mostly_wanted(texts, wanted), words, similarity), "similar-links")
        # With many partitions, even empty shuffles are many small files.
        _free_shuffles(docs.sparkSession)
        if not links.isEmpty():
            known = labels.select(F.col("doc_id").alias("id"), F.col("component_id").alias("lead_id"))
            labels = _components(known.unionByName(links)).filter("doc_id != component_id")
            labels = cut_lineage(labels, "similar-labels")
            _free_shuffles(docs.sparkSession)
        members = members.drop("component").join(
            leads.select("shingle", F.col("lead_doc_id").alias("doc_id")), ["shingle", "doc_id"], "left_anti"
        )
        leads_each *= 4
