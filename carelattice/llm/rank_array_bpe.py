"""BPE encoding and decoding with a contiguous array of ranks for each word.

A word is held as its part boundaries and, in one array beside them, the merge rank of each pair of
neighbouring parts. The array is scanned for its minimum, leftmost first; the boundary inside that
pair is deleted, and only the ranks of the two neighbouring pairs are looked up again, until no pair
has a rank. All new words of a slab are worked on together, as rows of a matrix: words of p parts
either end or go on with p - 1 parts, so one sweep from the longest word down does every merge.

A scan costs as much as the word is long, so words of more than `SHORT` bytes are merged through a
queue of ranks instead; the merges are the same. Strings of added tokens are cut out of a text first
and stand for themselves.

Nothing is shuffled: no text needs another one. The driver reads the tokenizer file, whose size is
checked, and broadcasts it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs
from carelattice.llm.byte_bpe import character_kinds, piece_starts

#: Words up to so many bytes are scanned and remembered; longer ones go through a queue.
SHORT = 64
#: Bytes of text handled at once, words remembered by a Python worker, and words merged together.
SLAB_BYTES = 1 << 20
REMEMBERED = 200_000
TOGETHER = 20_000
#: A tokenizer file of more bytes is refused: it is broadcast.
MAX_FILE_BYTES = 64 << 20


class Model:
    """Tokens and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, splitter = content["model"], content["pre_tokenizer"]
        plain = (
            model["type"] == "BPE" and splitter["type"] == "ByteLevel" and content["normalizer"] is None
            and splitter.get("use_regex", True) and not splitter["add_prefix_space"]
            and not any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges",
                "byte_fallback"))
        )
        if not plain:
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.added: dict[bytes, int] = {}
        for token in content["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"{path}: {token['content']} matches by more than its own text")
            self.added[token["content"].encode()] = token["id"]
        byte_of = _written_bytes()
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        numbers = model["vocab"]
        self.tokens = [b""] * (max([*numbers.values(), *self.added.values()]) + 1)
        for token, number in numbers.items():
            self.tokens[number] = as_bytes(token)
        for token, number in self.added.items():
            self.tokens[number] = token
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in byte_of.items():
            self.byte_ids[byte] = numbers[letter]
        #: (left id, right id) as one number, to the rank; and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        made = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[numbers[left] << 32 | numbers[right]] = len(made)
            made.append(numbers[left + right])
        self.made = np.array(made, np.int32)


def _written_bytes() -> dict[str, int]:
    """The byte that each character of a written token stands for: printable bytes are written as
    themselves, the others in order as the characters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes texts and remembers the short words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.kinds = character_kinds()
        self.none = len(model.made)
        keys = np.fromiter(model.ranks, np.int64, len(model.ranks))
        order = np.argsort(keys)
        # One key above all others ends every search.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.fromiter(model.ranks.values(), np.int32, len(model.ranks))
        self.values = np.append(values[order], np.int32(self.none))
        self.met: dict[bytes, bytes] = {}
        added = sorted(model.added, key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], np.int32(self.none))

    def merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by scans of its rank array."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        rows = np.zeros(0, np.int64)
        parts, ranks = np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for p in range(int(sizes.max(initial=0)), 0, -1):
            fresh = np.flatnonzero(sizes == p)
            if len(fresh):
                letters = np.frombuffer(b"".join(words[i] for i in fresh.tolist()), np.uint8)
                own = self.model.byte_ids[letters].reshape(-1, p)
                own_ranks = self.pair_ranks(own[:, :-1], own[:, 1:])
                known = len(rows) > 0
                rows = np.concatenate([rows, fresh])
                parts = np.concatenate([parts, own]) if known else own
                ranks = np.concatenate([ranks, own_ranks]) if known else own_ranks
            if not len(rows):
                continue
            if p == 1:
                for row, ids in zip(rows.tolist(), parts, strict=True):
                    done[row] = ids
                break
            at = ranks.argmin(1)
            lowest = ranks[np.arange(len(rows)), at]
            ended = lowest == self.none
            for row, ids in zip(rows[ended].tolist(), parts[ended], strict=True):
                done[row] = ids
            going = ~ended
            rows, at, lowest = rows[going], at[going], lowest[going]
            line = np.arange(len(rows))
            parts, ranks = parts[going], ranks[going]
            # The boundary after the left part goes, and with it the pair's own rank.
            parts[line, at] = self.model.made[lowest]
            kept = np.ones(parts.shape, bool)
            kept[line, at + 1] = False
            parts = parts[kept].reshape(len(rows), p - 1)
            kept = np.ones(ranks.shape, bool)
            kept[line, at] = False
            ranks = ranks[kept].reshape(len(rows), p - 2)
            for side in (at - 1, at):
                held = np.flatnonzero((side >= 0) & (side < p - 2))
                pair = side[held]
                ranks[held, pair] = self.pair_ranks(parts[held, pair], parts[held, pair + 1])
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word: the lowest rank from a queue, leftmost first."""
        parts = self.model.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        find, made = self.model.ranks.get, self.model.made
        first = self.pair_ranks(np.array(parts[:-1], np.int32), np.array(parts[1:], np.int32))
        queue = [(rank, i) for i, rank in enumerate(first.tolist()) if rank < self.none]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            # A part merged since then makes another rank with its neighbour, or none.
            if parts[i] < 0 or j < 0 or find(parts[i] << 32 | parts[j]) != rank:
                continue
            parts[i], parts[j] = int(made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    found = find(parts[left] << 32 | parts[right])
                    if found is not None:
                        heapq.heappush(queue, (found, left))
        return np.array([part for part in parts if part >= 0], np.int32)

    def _words(self, flat: np.ndarray, borders: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The words and added tokens of all texts in order, and where those of each text begin."""
        whole = flat.tobytes()
        cuts = borders
        if self.added is not None and (spans := [m.span() for m in self.added.finditer(whole)]):
            at = np.array(spans, np.int64)
            # A match over the end of a text is none; it is searched again text by text.
            if (np.searchsorted(borders, at[:, 0], "right") != np.searchsorted(borders, at[:, 1], "left")).any():
                at = np.array([
                    (a + m.start(), a + m.end())
                    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)
                    for m in self.added.finditer(whole[a:b])
                ], np.int64).reshape(-1, 2)
            cuts = np.unique(np.concatenate([borders, at.ravel()]))
            tokens = at
        else:
            tokens = np.zeros((0, 2), np.int64)
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        sizes = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        point_at = np.append(0, np.cumsum(sizes, dtype=np.int64))
        starts = point_at[piece_starts(points, np.searchsorted(point_at, cuts[:-1]), self.kinds)]
        if len(tokens):
            # Inside an added token nothing else begins.
            token = np.searchsorted(tokens[:, 0], starts, "right") - 1
            inside = (token >= 0) & (starts > tokens[token, 0]) & (starts < tokens[token, 1])
            starts = starts[~inside]
        ends = np.append(starts[1:], len(flat))[: len(starts)]
        words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return words, np.searchsorted(starts, borders)

    def encode(self, flat: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
        """The ids of each of the texts, which stand one after another in `flat`."""
        words, first = self._words(flat, borders)
        if len(self.met) > REMEMBERED:
            self.met.clear()
        met, here = self.met, {}
        new = [w for w in dict.fromkeys(words) if w not in met]
        for word in [w for w in new if w in self.model.added]:
            here[word] = np.int32(self.model.added[word]).tobytes()
        short = [w for w in new if len(w) <= SHORT and w not in here]
        for start in range(0, len(short), TOGETHER):
            part = short[start : start + TOGETHER]
            met.update(zip(part, (ids.tobytes() for ids in self.merge_short(part)), strict=True))
        for word in new:
            if len(word) > SHORT and word not in here:
                here[word] = self.merge_long(word).tobytes()
        find = met.__getitem__ if not here else {**met, **here}.__getitem__
        return [
            np.frombuffer(b"".join(map(find, words[a:b])), np.int32)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
        ]


#: The encoder of the last tokenizer file in a Python worker, kept from task to task.
_encoders: dict[str, Encoder] = {}


def _encoder(key: str, model: Model) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id and the array `ids` of every text, one row for each row of `docs`.

    A null or empty text has no ids; rows without an id, equal rows and rows of one id are encoded
    each; an empty table gives an empty result; other columns are not read. A text is encoded in one
    task, with memory in proportion to its length.
    """
    with open(path, "rb") as file:
        key = hashlib.file_digest(file, "sha256").hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in slabs(batches, SLAB_BYTES):
            ids = encoder.encode(*flat_bytes(batch.column(1)))
            borders = np.append(0, np.cumsum([len(one) for one in ids])).astype(np.int32)
            joined = np.concatenate([np.zeros(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(borders), pa.array(joined))], ["doc_id", "ids"]
            )

    texts = id_and_text(docs, id_column, text_column)
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """`encoded` with a further column of the text that the ids stand for.

    Bytes that are no UTF-8 become the replacement character. Null ids and an empty array give the
    empty text; an id that the tokenizer does not have is an error. A column that already has the
    new one's name is replaced.
    """
    others = [c for c in encoded.columns if c.lower() != text_column.lower()]
    schema = encoded.select(*others).schema.add(text_column, "string")
    place = others.index(ids_column)
    shared = encoded.sparkSession.sparkContext.broadcast(Model(path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(place):
                held = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                if held and min(held) < 0:
                    raise ValueError("negative token id")
                texts.append(b"".join([tokens[i] for i in held]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*others, text_column]
            )

    return encoded.select(*others).mapInArrow(run, schema)


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text of encoded and decoded rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
