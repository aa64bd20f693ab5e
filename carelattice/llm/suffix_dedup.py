"""Removal of byte strings that start anywhere else, by sorted suffixes.

Every window of `length` bytes is anchored at the leftmost smallest hash of the grams (half as long)
inside it, which depends on the window's bytes alone: equal windows have equal anchors at equal
places. So it is enough to sort the suffixes that start at anchors, forwards from the anchor and
backwards from its gram's end; two windows are equal where both orders have common prefixes that
are long enough.

Anchors whose gram occurs once are done. Where the whole stretch of an anchor's windows occurs
twice, by a 128-bit hash of gram and stretch, all of them are repeated. Only what is left, the
frayed ends of repeated passages, is sorted: multikey quicksort to a shallow depth, eight bytes
at a time, then a blind trie for each group with a longer common prefix. The common prefixes of
neighbours give, for every depth, which suffixes agree to it.

Copies within a slab of documents are settled before anything is shuffled, and send one row.
A gram with very many different stretches is split: its windows are counted by their own hash,
where equal ones collapse before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs
from carelattice.llm.wordarrays import mixed
from carelattice.session import cut_lineage

LENGTH = 200
#: Bytes that the multikey quicksort compares before the blind tries take over.
SHALLOW = 16
#: Different stretches of one gram that are sorted together; more are split into windows.
TOGETHER = 100_000
_SLAB = 1 << 20
_CHUNK = 40_000

# An odd base and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE_BITS = 28  # of a position within a slab
_FIELD = 12  # bits of an offset from an anchor


class Anchors:
    """Finds the anchors of all windows in a slab of texts."""

    def __init__(self, length: int):
        self.length, self.gram = length, length // 2
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def __call__(self, flat: np.ndarray, borders: np.ndarray):
        """(gram hash, text, anchor, first window, last window) of each stretch of windows with
        one anchor; places are in the slab."""
        n, width = len(flat), self.length - self.gram + 1
        sizes = np.diff(borders) - self.length + 1
        texts = np.flatnonzero(sizes > 0)
        if not len(texts):
            return tuple(np.zeros(0, t) for t in (np.uint64, *[np.int64] * 4))
        self._tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(11)) * self.powers[:n], out=sums[1:])
        grams = n - self.gram + 1
        hashes = (sums[self.gram :] - sums[:grams]) * self.inverses[:grams]
        hashes = mixed(hashes, np.zeros(1, np.uint64))
        places = np.arange(grams, dtype=np.uint64)
        keys = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | places
        # Minimum of each run of `width` keys: from running minima forwards and backwards in blocks.
        padded = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:grams] = keys
        blocks = padded.reshape(-1, width)
        forwards = np.minimum.accumulate(blocks, axis=1).ravel()
        backwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        counts = sizes[texts]
        windows = np.repeat(borders[texts] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        smallest = np.minimum(backwards[windows], forwards[windows + width - 1])
        anchors = (smallest & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchors, prepend=-1))
        last = np.append(first[1:], len(anchors)) - 1
        anchor = anchors[first]
        text = np.searchsorted(borders, anchor, side="right") - 1
        return hashes[anchor], text, anchor, windows[first], windows[last]


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """gram, stretch, n, doc_id, at: the stretches of windows, each kind once for each slab.

    `at` packs the anchor's place in its text and how far before it the first and the last window
    start. Rows with n = 0 repeat within their slab; one row of theirs stands for them with n > 1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length)
        for batch in slabs(batches, _SLAB):
            flat, borders = flat_bytes(batch.column(1))
            gram, text, anchor, low, high = find(flat, borders)
            whole = flat.tobytes()
            hash_of = xxhash.xxh3_64_intdigest
            stretch = np.array(
                [
                    hash_of(whole[a : b + length], c - a)
                    for a, b, c in zip(low.tolist(), high.tolist(), anchor.tolist(), strict=True)
                ],
                np.uint64,
            )
            ids = batch.column(0).to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int64)
            at = (anchor - borders[text]) << 2 * _FIELD | (anchor - low) << _FIELD | (anchor - high)
            order = np.lexsort((stretch, gram))
            gram, stretch, ids, at = gram[order], stretch[order], ids[order], at[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (stretch[1:] != stretch[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(gram)))
            repeated = np.flatnonzero(np.repeat(sizes > 1, sizes))
            # Settled rows go anywhere: their own place is their key.
            spread = mixed(ids[repeated].astype(np.uint64), at[repeated].astype(np.uint64))
            columns = (
                (gram[starts], spread), (stretch[starts], stretch[repeated]),
                (sizes, np.zeros(len(repeated), np.int64)), (ids[starts], ids[repeated]),
                (at[starts], at[repeated]),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(pair).astype(np.int64, copy=False).view(np.int64)) if i > 1
                 else pa.array(np.concatenate(pair).view(np.int64)) for i, pair in enumerate(columns)],
                ["gram", "stretch", "n", "doc_id", "at"],
            )

    return docs.mapInArrow(run, "gram bigint, stretch bigint, n bigint, doc_id bigint, at bigint")


def _judged(stretches: DataFrame) -> DataFrame:
    """gram, doc_id, at, repeated, compared, many of all stretches whose gram occurs again.

    repeated: all its windows are. compared: its text has to be compared, because its gram occurs
    with another stretch; of equal stretches one is, with `many` set.
    """
    alike = Window.partitionBy("gram", "stretch")
    ordered = alike.orderBy("doc_id", "at")
    same_gram = Window.partitionBy("gram")
    counted = stretches.repartition("gram").select(
        "gram", "doc_id", "at", "n",
        F.sum("n").over(alike).alias("total"), F.row_number().over(ordered).alias("place"),
        (F.min("stretch").over(same_gram) != F.max("stretch").over(same_gram)).alias("mixed"),
    )
    repeated = (F.col("n") == 0) | (F.col("total") > 1)
    return counted.select(
        "gram", "doc_id", "at", repeated.alias("repeated"),
        (F.col("mixed") & (F.col("n") > 0) & (F.col("place") == 1)).alias("compared"),
        (F.col("total") > 1).alias("many"),
    ).filter("repeated or compared")


def _texts_of(requests: DataFrame, dealt: DataFrame, length: int) -> DataFrame:
    """The requested stretches with their bytes."""
    listed = requests.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "at", "many")).alias("asked"))
    schema = "gram bigint, doc_id bigint, at bigint, many boolean, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << _FIELD) - 1
        for batch in slabs(batches, 4 << 20):
            ids, texts, asked = (batch.column(i) for i in range(3))
            rows = []
            for i in range(batch.num_rows):
                content = texts[i].as_py().encode()
                name = ids[i].as_py()
                for one in asked[i].as_py():
                    at = one["at"]
                    anchor = at >> 2 * _FIELD
                    low, high = anchor - (at >> _FIELD & mask), anchor - (at & mask)
                    rows.append((one["gram"], name, at, one["many"], content[low : high + length]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["gram", "doc_id", "at", "many", "content"],
            )

    return dealt.join(listed, "doc_id").select("doc_id", "text", "asked").mapInArrow(run, schema)


def common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    apart = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return size - (apart.bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie that stores depths and branching bytes only.

    To insert a string, descend by its bytes at the branching depths, blindly; compare once with
    the leaf reached; and branch where they part. A node is [depth, {byte: child}]; a leaf is the
    list of the strings equal to it. -1 stands for a string's end.
    """

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.root: list = [members[0]]
        self.is_leaf = True
        for member in members[1:]:
            self._insert(member)

    def _insert(self, member: int) -> None:
        string = self.strings[member]
        node = self.root
        while isinstance(node[-1], dict):
            depth, children = node
            byte = string[depth] if depth < len(string) else -1
            child = children.get(byte)
            node = child if child is not None else next(iter(children.values()))
        other = self.strings[node[0]]
        if string == other:
            node.append(member)
            return
        depth = common_prefix(string, other)
        byte = string[depth] if depth < len(string) else -1
        parent, node = None, self.root
        while isinstance(node[-1], dict) and node[0] < depth:
            parent, node = node, node[1][string[node[0]]]
        if isinstance(node[-1], dict) and node[0] == depth:
            node[1][byte] = [member]
            return
        below = other[depth] if depth < len(other) else -1
        branch = [depth, {below: node, byte: [member]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][string[parent[0]]] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """Members in order, and each one's common prefix with the one before (0 for the first)."""
        order: list[int] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node[-1], dict):
                depth, children = node
                branches = sorted(children)
                for byte in reversed(branches[1:]):
                    stack.append((children[byte], depth))
                stack.append((children[branches[0]], shared))
            else:
                order += node
                common += [shared] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, common


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and each one's common prefix with the one before it.

    Common prefixes shorter than `shallow` are given as 0.
    """
    n = len(strings)
    heads = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8")
    heads = heads.reshape(n, shallow // 8).astype(np.uint64)
    # Multikey quicksort: by the first eight bytes, then what is equal so far by the next eight.
    order = np.argsort(heads[:, 0], kind="quicksort")
    new = np.ones(n, bool)
    new[1:] = heads[order[1:], 0] != heads[order[:-1], 0]
    for word in range(1, heads.shape[1]):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        inner = np.lexsort((heads[order[tied], word], group[tied]))
        order[tied] = order[tied[inner]]
        new[1:] |= heads[order[1:], word] != heads[order[:-1], word]
    common = np.zeros(n, np.int64)
    borders = np.append(np.flatnonzero(new), n)
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a > 1:
            order[a:b], common[a:b] = BlindTrie(strings, order[a:b].tolist()).walk()
    return order, common


def _repeated_runs(rows: pa.RecordBatch, length: int):
    """doc_id, start, end of what is repeated among the stretches of whole grams."""
    gram = length // 2
    mask = (1 << _FIELD) - 1
    at = rows.column(2).to_numpy()
    many = rows.column(3).to_numpy(zero_copy_only=False)
    before, behind = at >> _FIELD & mask, at & mask  # first and last window before the anchor
    contents = rows.column(4).to_pylist()
    offsets = before.tolist()
    n = len(contents)
    orders = (
        deep_shallow_sort([c[o:] for c, o in zip(contents, offsets, strict=True)]),
        deep_shallow_sort([c[: o + gram][::-1] for c, o in zip(contents, offsets, strict=True)]),
    )
    width = length - gram + 1
    found = np.zeros((n, width + 1), bool)
    classes = np.zeros((2, n), np.int64)
    for d in range(width):
        members = np.flatnonzero((before >= d) & (behind <= d))
        if len(members) < 2:
            continue
        for k, depth in enumerate((length - d, gram + d)):
            order, common = orders[k]
            classes[k, order] = np.cumsum(common < depth)
        keys = classes[0, members] * (n + 1) + classes[1, members]
        _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        found[members, d] = counts[place] > 1
    found[many] = False  # settled already
    # Runs of windows: from d down to e are the windows at anchor - d .. anchor - e.
    edges = np.diff(found.astype(np.int8), axis=1, prepend=0)
    member, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    anchor = at[member] >> 2 * _FIELD
    return rows.column(1).to_numpy()[member], anchor - (high - 1), anchor - low + length


def _compared(contents: DataFrame, length: int) -> DataFrame:
    """doc_id, start, end: repeated bytes in the stretches, grams dealt out whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
            columns = _repeated_runs(rows, length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(part.num_rows for part in held) >= _CHUNK:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                grams = rows.column(0).to_numpy()
                cut = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on
                if cut:
                    yield settle(rows.slice(0, cut))
                    held = [rows.slice(cut)]
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = contents.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, end bigint")


def _by_windows(contents: DataFrame, length: int) -> DataFrame:
    """doc_id, start, end: the same for grams with very many stretches, window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << _FIELD) - 1
        for batch in batches:
            rows = []
            for name, at, many, content in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                start = (at >> 2 * _FIELD) - (at >> _FIELD & mask)
                for k in range(len(content) - length + 1):
                    rows.append((xxhash.xxh3_128_hexdigest(content[k : k + length]), name, start + k, 2 if many else 1))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["print", "doc_id", "start", "n"]
            )

    windows = contents.mapInArrow(run, "print string, doc_id bigint, start bigint, n bigint")
    again = windows.groupBy("print").agg(F.sum("n").alias("total")).filter("total > 1")
    return windows.join(again, "print").select("doc_id", "start", (F.col("start") + length).alias("end"))


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, together: int = TOGETHER,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, start, end: byte stretches covered by strings of `length` bytes that start anywhere
    else; they may touch and overlap. Ids are unique, or rows repeat wholly; rows without an id
    take no part. `length` is even and at most 4,000."""
    texts = id_and_text(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    texts = texts.filter("doc_id is not null")
    judged = cut_lineage(_judged(_stretches(texts, length)), "stretches")
    mask = (1 << _FIELD) - 1
    anchor = F.shiftright("at", 2 * _FIELD)
    settled = judged.filter("repeated").select(
        "doc_id", (anchor - F.shiftright("at", _FIELD).bitwiseAND(mask)).alias("start"),
        (anchor - F.col("at").bitwiseAND(mask) + length).alias("end"),
    )
    requests = judged.filter("compared").select("gram", "doc_id", "at", "many")
    large = cut_lineage(
        requests.groupBy("gram").count().filter(F.col("count") > together).select("gram"), "large-grams"
    )
    dealt = _dealt(texts)
    if large.isEmpty():
        return settled.unionByName(_compared(_texts_of(requests, dealt, length), length))
    contents = cut_lineage(_texts_of(requests, dealt, length), "stretch-texts")
    return (
        settled.unionByName(_compared(contents.join(large, "gram", "left_anti").select(*contents.columns), length))
        .unionByName(_by_windows(contents.join(large, "gram", "left_semi").select(*contents.columns), length))
    )


def _dealt(texts: DataFrame) -> DataFrame:
    """The texts dealt by id: both joins of a plan read this one exchange."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(partitions, "doc_id")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, together: int = TOGETHER,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 of every row.

    Every byte covered by a string of `length` bytes that starts anywhere else, in this or another
    text, is removed; strings are judged on the texts as given and never reach over a text's end.
    Null and empty texts and texts shorter than `length` lose nothing. Repeated rows repeat each
    other. Rows without an id lose nothing and make nothing repeated. An empty table gives an
    empty result; other columns are not read.
    """
    texts = id_and_text(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spans = repeated_spans(docs, length, together, id_column, text_column).distinct()
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, 4 << 20):
            flat, borders = flat_bytes(batch.column(1))
            whole = flat.tobytes()
            rows = []
            for i, spans in enumerate(batch.column(2)):
                text = whole[borders[i] : borders[i + 1]]
                kept, last, runs = [], 0, 0
                for start, end in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if start > last or not runs:
                        kept.append(text[last:start])
                        runs += 1
                    last = max(last, end)
                kept.append(text[last:])
                left = b"".join(kept)
                rows.append((len(text), len(text) - len(left), runs, left, hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    named = _dealt(texts.filter("doc_id is not null")).join(listed, "doc_id", "left")
    unnamed = texts.filter("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<start: bigint, end: bigint>>"))
    joined = named.select("doc_id", "text", "spans").unionByName(unnamed.select("doc_id", "text", "spans"))
    return joined.mapInArrow(run, schema)
