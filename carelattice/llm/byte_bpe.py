"""Byte-level BPE encoding and decoding by replaying merges over a whole corpus at once.

Texts are cut into pieces, equal pieces of a slab of documents are found once, and only pieces
that a task has not met yet are encoded, all of them together: an inverted index leads from each
pair of neighbouring tokens to its positions in all pieces, pairs are merged in rank order
wherever they stand, and only the two neighbours of a merged pair are looked at again. Ids and
decoded bytes of the documents are then gathered from the encoded pieces.

No step needs another document, so nothing is shuffled. The vocabulary, at most a few hundred
thousand entries by its kind, is read by the driver and broadcast.

A merge makes a longer token, whose own pairs normally rank later. Should one rank earlier than
the merge being replayed, its piece is encoded by itself, lowest rank first from the left.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs

#: Bytes of text handled at once, and pieces remembered by a Python worker.
SLAB_BYTES = 1 << 20
REMEMBERED = 400_000

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# The endings that the pattern splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
# Unicode's White_Space, which the pattern's \s stands for.
_WHITE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            kinds[point] = _LETTER
        elif major == "N":
            kinds[point] = _NUMBER
    kinds[list(_WHITE)] = _SPACE
    return kinds


def piece_starts(points: np.ndarray, text_starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of several texts one after another.

    A run of letters, of numbers or of others takes one space before it along. White space
    before something else is a piece up to its last character; that one is a piece of its own
    unless it is the space taken along. An apostrophe that begins a piece is split off with one
    of the known endings.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    fresh = np.zeros(n + 1, bool)
    fresh[text_starts[text_starts < n]] = True
    fresh[n] = True
    starts = fresh[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    last_white = np.zeros(n, bool)
    last_white[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~fresh[1:n]
    starts |= last_white
    taken = np.zeros(n, bool)
    taken[1:] = (last_white & (points == 0x20))[:-1]
    starts &= ~taken
    lone = np.flatnonzero((points == 0x27) & starts)
    for ending in _ENDINGS:
        size = len(ending)
        at = lone[lone + size < n]
        for k, letter in enumerate(ending, 1):
            at = at[(points[at + k] == ord(letter)) & ~fresh[at + k]]
        starts[at + 1] = False
        if size == 2:
            starts[at + 2] = False
        after = at + 1 + size
        starts[after[after < n]] = True
        lone = np.setdiff1d(lone, at, assume_unique=True)
    return np.flatnonzero(starts)


class Vocabulary:
    """Ranks, the pairs that merge to each, and each token's bytes and decimal text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.merges: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = rank
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_flat, self.token_at = _flatten(tokens)
        self.number_flat, self.number_at = _flatten([b"%d " % i for i in range(size)])
        self.byte_ranks = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.made = np.append(
            np.fromiter(self.merges.values(), np.int32, len(self.merges))[order], np.int32(-1)
        )

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token each pair merges to, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = 0
        at = np.searchsorted(self.keys, keys)
        return np.where(
            (self.keys[at] == keys) & (left >= 0) & (right >= 0), self.made[at], np.int32(-1)
        )


def _flatten(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=at[1:])
    return np.frombuffer(b"".join(values), np.uint8), at


def encode_alone(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """One piece: the lowest rank first, from the left."""
    ids = [int(vocabulary.byte_ranks[b]) for b in piece]
    merges = vocabulary.merges
    while len(ids) > 1:
        rank, at = min(
            (merges.get(ids[i] << 32 | ids[i + 1], 1 << 40), i) for i in range(len(ids) - 1)
        )
        if rank == 1 << 40:
            break
        ids[at : at + 2] = [rank]
    return ids


def replay(flat: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every piece of a ragged byte array, all merged together, and their borders."""
    count = len(at) - 1
    # Before, between and after the pieces stands -1, over which no pair reaches.
    places = np.arange(len(flat)) + np.repeat(np.arange(1, count + 1), np.diff(at))
    n = len(flat) + count + 1
    tokens = np.full(n, -1, np.int32)
    tokens[places] = vocabulary.byte_ranks[flat]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    # The rank that the token at a position makes with its right neighbour.
    ranks = np.full(n, -1, np.int32)
    ranks[:-1] = vocabulary.pair_ranks(tokens[:-1], tokens[1:])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(positions: np.ndarray, found: np.ndarray) -> None:
        order = np.argsort(found, kind="stable")
        positions, found = positions[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for rank, group in zip(
            found[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True
        ):
            if rank in index:
                index[rank].append(group)
            else:
                index[rank] = [group]
                heapq.heappush(queue, rank)

    starting = np.flatnonzero(ranks >= 0)
    if len(starting):
        note(starting, ranks[starting])
    early: list[np.ndarray] = []
    while queue:
        merged = heapq.heappop(queue)
        groups = index.pop(merged)
        lefts = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
        lefts = lefts[ranks[lefts] == merged]
        if not len(lefts):
            continue
        rights = after[lefts]
        if (ranks[rights] == merged).any():
            # Runs of one token: pair them off from the left.
            used: set[int] = set()
            chosen = []
            for i, j in zip(lefts.tolist(), rights.tolist(), strict=True):
                if i not in used:
                    chosen.append(i)
                    used.add(j)
            lefts = np.array(chosen)
            rights = after[lefts]
        nexts = after[rights]
        tokens[lefts] = merged
        tokens[rights] = -2
        ranks[rights] = -1
        after[lefts] = nexts
        before[nexts] = lefts
        previous = before[lefts]
        with_next = vocabulary.pair_ranks(tokens[lefts], tokens[nexts])
        with_previous = vocabulary.pair_ranks(tokens[previous], tokens[lefts])
        ranks[lefts] = with_next
        ranks[previous] = with_previous
        positions = np.concatenate([lefts, previous])
        found = np.concatenate([with_next, with_previous])
        if ((found >= 0) & (found < merged)).any():
            early.append(positions[(found >= 0) & (found < merged)])
        positions, found = positions[found >= 0], found[found >= 0]
        if len(found):
            note(positions, found)
    borders = np.append(0, np.cumsum(tokens >= 0))[at + np.arange(count + 1)]
    ids = tokens[tokens >= 0]
    if early:
        again = np.unique(np.searchsorted(at + np.arange(count + 1), np.concatenate(early), "right")) - 1
        parts = [ids[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
        for i in again:
            parts[i] = np.array(encode_alone(flat[at[i] : at[i + 1]].tobytes(), vocabulary), np.int32)
        ids = np.concatenate(parts)
        borders = np.append(0, np.cumsum([len(part) for part in parts]))
    return ids, borders


def _gather(flat: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen rows of a ragged array one after another, and their borders."""
    sizes = at[chosen + 1] - at[chosen]
    borders = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(sizes, out=borders[1:])
    positions = np.repeat(at[chosen] - borders[:-1], sizes) + np.arange(borders[-1])
    return flat[positions], borders


class Encoder:
    """Encodes slabs of texts and remembers the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        self.vocabulary = Vocabulary(ranks)
        self.kinds = character_kinds()
        self.remembered = remembered
        self.multiplier = 0x9E3779B97F4A7C15
        self.powers = np.zeros(0, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _hashed(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit polynomial hash of each piece, mixed with its length."""
        lengths = ends - starts
        longest = int(lengths.max())
        if len(self.powers) < longest:
            powers = np.full(longest, self.multiplier, np.uint64)
            powers[0] = 1
            self.powers = np.multiply.accumulate(powers)
        exponents = np.arange(len(flat)) - np.repeat(starts, lengths)
        sums = np.add.reduceat((flat.astype(np.uint64) + np.uint64(7)) * self.powers[exponents], starts)
        sums ^= sums >> np.uint64(29)
        sums = sums * np.uint64(0xBF58476D1CE4E5B9) + lengths.astype(np.uint64)
        return sums ^ (sums >> np.uint64(32))

    def encode(self, flat: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and their n+1 borders."""
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(borders), np.int64)
        whole = flat.tobytes()
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        point_at = np.zeros(len(points) + 1, np.int64)
        sizes = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        np.cumsum(sizes, out=point_at[1:])
        text_starts = np.searchsorted(point_at, borders[:-1])
        starts = point_at[piece_starts(points, text_starts, self.kinds)]
        ends = np.append(starts[1:], len(flat))
        hashes, first, place = np.unique(
            self._hashed(flat, starts, ends), return_index=True, return_inverse=True
        )
        if len(self.hashes) + len(hashes) > self.remembered:
            self.forget()
        self._learn(whole, hashes, starts[first], ends[first])
        rows = self.rows[np.searchsorted(self.hashes, hashes)][place]
        ids, piece_borders = _gather(self.flat, self.at, rows)
        first_piece = np.searchsorted(starts, borders)
        return ids, piece_borders[first_piece]

    def encode_again(self, flat: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with other hashes, until every piece decodes to itself."""
        while True:
            self.forget()
            self.multiplier = self.multiplier * 0xD1342543DE82EF95 % (1 << 64)
            self.powers = self.powers[:0]
            ids, at = self.encode(flat, borders)
            if np.array_equal(self.decode(ids)[0], flat):
                return ids, at

    def _learn(self, whole: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        spot = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = spot < len(self.hashes)
        known[inside] = self.hashes[spot[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        # A piece that is itself a token needs no merge.
        find = self.vocabulary.ranks.get
        tokens = np.fromiter(
            (find(whole[a:b], -1) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)),
            np.int32, len(new),
        )
        new = np.concatenate([new[tokens >= 0], new[tokens < 0]])
        tokens = tokens[tokens >= 0]
        rest = new[len(tokens) :]
        flat = np.frombuffer(whole, np.uint8)
        span = np.stack([starts[rest], ends[rest]], 1).ravel()
        span = np.append(span, span[-1:] if len(span) else [0])
        pieces, piece_at = _gather(flat, span, np.arange(0, 2 * len(rest), 2))
        ids, id_at = replay(pieces, piece_at, self.vocabulary)
        last = self.at[-1] + len(tokens)
        self.rows = np.concatenate([self.rows, len(self.at) - 1 + np.arange(len(new))])
        self.flat = np.concatenate([self.flat, tokens, ids])
        self.at = np.concatenate(
            [self.at, self.at[-1] + 1 + np.arange(len(tokens)), last + id_at[1:]]
        )
        merged = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(merged, kind="stable")
        self.hashes, self.rows = merged[order], self.rows[order]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids one after another, and each id's borders."""
        return _gather(self.vocabulary.token_flat, self.vocabulary.token_at, ids.astype(np.int64))

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id's decimal text and one space, and the borders."""
        return _gather(self.vocabulary.number_flat, self.vocabulary.number_at, ids.astype(np.int64))


#: One encoder for each vocabulary in a Python worker, kept from task to task.
_encoders: dict[str, Encoder] = {}


def _encoder(key: str, ranks: dict[bytes, int]) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _encoded(docs: DataFrame, vocabulary_path: str, schema: str, rows) -> DataFrame:
    ranks = read_ranks(vocabulary_path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in slabs(batches, SLAB_BYTES):
            flat, borders = flat_bytes(batch.column(1))
            ids, at = encoder.encode(flat, borders)
            decoded, token_at = encoder.decode(ids)
            if not np.array_equal(decoded, flat):
                # Two pieces share a hash: forget the pieces met and take other powers.
                ids, at = encoder.encode_again(flat, borders)
                decoded, token_at = encoder.decode(ids)
            yield rows(batch.column(0), encoder, ids, at, decoded, token_at)

    return docs.mapInArrow(run, schema)


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id and the array `ids` of every text, one row for each row of `docs`.

    A null or empty text has no ids. Repeated rows are encoded again; an empty table gives an
    empty result; other columns are not read.
    """
    def rows(names, encoder, ids, at, decoded, token_at):
        return pa.RecordBatch.from_arrays(
            [names, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
            ["doc_id", "ids"],
        )

    texts = id_and_text(docs, id_column, text_column)
    kind = dict(texts.dtypes)["doc_id"]
    return _encoded(texts, vocabulary_path, f"doc_id {kind}, ids array<int>", rows)


def decode_documents(
    encoded: DataFrame, vocabulary_path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """doc_id and the bytes that the ids of each row stand for; null ids decode to no bytes."""
    ranks = read_ranks(vocabulary_path)
    shared = encoded.sparkSession.sparkContext.broadcast(
        {rank: token for token, rank in ranks.items()}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.__getitem__
        for batch in batches:
            content = [b"".join(map(find, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"]
            )

    rows = encoded.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids"),
    )
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, content binary")


def token_digests(
    docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the decimal ids and of the decoded bytes."""
    def rows(names, encoder, ids, at, decoded, token_at):
        numbers, number_at = encoder.decimal(ids)
        number_view, decoded_view = memoryview(numbers), memoryview(decoded)
        listed, content = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            end = number_at[b] - 1 if b > a else number_at[a]
            listed.append(hashlib.sha256(number_view[number_at[a] : end]).hexdigest())
            content.append(hashlib.sha256(decoded_view[token_at[a] : token_at[b]]).hexdigest())
        return pa.RecordBatch.from_arrays(
            [names, pa.array(np.diff(at)), pa.array(listed, pa.string()), pa.array(content, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    texts = id_and_text(docs, id_column, text_column)
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(texts, vocabulary_path, schema, rows)
