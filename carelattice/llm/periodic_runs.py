"""Runs of words that repeat with a period at least three times, by string synchronising sets.

At a scale of t words (t = 8, 16, 32, ...) a position is chosen by the hashes of the t-word windows
around it: it is in the set if the smallest hash among the t + 1 windows that begin from it on is
that of the first or of the last. Which positions are chosen depends on the next 2t words only, so
equal stretches of words are cut alike, and any t positions in a row hold a chosen one, but where all
windows have a period of t/3 or less: those windows are left out of the choice. Two chosen positions
with the same 2t words propose their distance as a period. A run of period q and three periods or
more has such a pair at distance q for the scale with 3t/2 <= q < 3t: outside a region of period p <=
t/3 the choice is dense, and inside one the run itself would have a smaller period than q. The
regions of small period are found separately: periods below 12 by comparing every word with the one
that many places on, others as the runs of smaller scales.

A proposal is judged by comparing words. Numbers of words are exact, windows are named by 64-bit hashes
of pairs of smaller windows, so a collision can at most hide or add a proposal with a chance of about
(words squared) / 2^64.

A text is worked on alone, in one task; several go through the arrays at once. Nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs
from carelattice.llm.wordarrays import mixed

#: A run has so many periods at least, and so many words.
PERIODS = 3
MIN_LENGTH = 24
#: The smallest scale; smaller periods than its own are found by direct comparison.
_FIRST = 8
_SMALL = 3 * _FIRST // 2 - 1
_LEFT_OUT = np.uint64(2**64 - 1)
SLAB_BYTES = 2 << 20
_CHUNK = 1 << 20


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of set flags."""
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return edges[::2], edges[1::2]


def _equal_until(words: np.ndarray, at: int, period: int, end: int) -> int:
    """The first place from `at` on whose word is not the one a period later, `end` for none."""
    step = 64
    while at < end:
        upto = min(at + step, end)
        differ = words[at:upto] != words[at + period : upto + period]
        if differ.any():
            return at + int(differ.argmax())
        at, step = upto, step * 2
    return end


def _equal_from(words: np.ndarray, at: int, period: int, low: int) -> int:
    """The first of the places before `at`, without a gap, whose words are those a period later."""
    step = 64
    while at > low:
        downto = max(at - step, low)
        differ = words[downto:at] != words[downto + period : at + period]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = downto, step * 2
    return low


def _windows(names: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows of twice the width; those over the end of all words name nothing."""
    out = np.zeros(len(names), np.uint64)
    out[:-width] = mixed(names[:-width], names[width:])
    return out


def _chosen(names: np.ndarray, scale: int, left: np.ndarray) -> np.ndarray:
    """The synchronising positions at a scale: `names` of the windows of that width, `_LEFT_OUT` for
    highly periodic ones; `left` says how many words of the text are left at a place."""
    lowest = names.copy()
    width = 1
    while width < scale:
        np.minimum(lowest[:-width], lowest[width:], out=lowest[:-width])
        width *= 2
    places = np.flatnonzero(left >= 2 * scale)
    first, last = names[places], names[places + scale]
    low = np.minimum(lowest[places], last)
    return places[(low != _LEFT_OUT) & ((low == first) | (low == last))]


def _proposals(places: np.ndarray, contexts: np.ndarray, text: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the pairs with equal contexts, in order of text, period and place."""
    keys = mixed(contexts, text.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], places[order]
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Contexts are not highly periodic, so few of them lie within a distance of three scales.
    for apart in range(1, len(at)):
        near = np.flatnonzero((keys[apart:] == keys[:-apart]) & (at[apart:] - at[:-apart] < 3 * scale))
        if not len(near):
            break
        starts.append(at[near])
        periods.append(at[near + apart] - at[near])
    found, period = np.concatenate(starts), np.concatenate(periods)
    taken = 2 * period >= 3 * scale
    found, period = found[taken], period[taken]
    order = np.lexsort((found, period, text[np.searchsorted(places, found)]))
    return found[order], period[order]


def find_runs(words: np.ndarray, borders: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of the runs of several texts, whose words are given as numbers,
    one text after another with their n+1 borders; by text, start and period."""
    sizes = np.diff(borders)
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = borders[text + 1] - np.arange(len(words))
    starts, ends, periods = ([np.zeros(0, np.int64)] for _ in range(3))
    for q in range(1, min(_SMALL, len(words) - 1) + 1):
        a, b = _stretches((words[:-q] == words[q:]) & (left[:-q] > q))
        keep = b - a >= max((PERIODS - 1) * q, _FIRST - q)
        starts.append(a[keep])
        ends.append(b[keep] + q)
        periods.append(np.full(int(keep.sum()), q))
    names = mixed(words.astype(np.uint64), np.uint64(1) + np.zeros(1, np.uint64))
    base = np.arange(len(words))
    width, scale = 1, _FIRST
    while True:
        # Only texts that can hold a run of this scale go on.
        keep = sizes[text] >= PERIODS * (3 * scale // 2)
        if not keep.any():
            break
        words, text, left, names, base = words[keep], text[keep], left[keep], names[keep], base[keep]
        while width < scale:
            names = _windows(names, width)
            width *= 2
        own = names.copy()
        known_start, known_end, known_period = map(np.concatenate, (starts, ends, periods))
        flat = (PERIODS * known_period <= scale) & (known_end - known_start >= scale)
        a = np.searchsorted(base, known_start[flat])
        held = (a < len(base)) & (base[np.minimum(a, len(base) - 1)] == known_start[flat])
        a = a[held]
        marks = np.zeros(len(base) + 1, np.int32)
        np.add.at(marks, a, 1)
        np.add.at(marks, a + (known_end - known_start)[flat][held] - scale + 1, -1)
        own[np.cumsum(marks[:-1]) > 0] = _LEFT_OUT
        places = _chosen(own, scale, left)
        names = _windows(names, width)
        width *= 2
        previous, reach = (-1, 0), -1
        found: list[tuple[int, int, int]] = []
        at, period = _proposals(places, names[places], text[places], scale)
        for i, q, t, rest in zip(at.tolist(), period.tolist(), text[at].tolist(), left[at].tolist(), strict=True):
            if (t, q) == previous and i < reach:
                continue
            end = i + rest
            reach = _equal_until(words, i, q, end - q)
            previous = (t, q)
            first = _equal_from(words, i, q, end - int(sizes[t]))
            if reach - first >= (PERIODS - 1) * q:
                found.append((int(base[first]), int(base[first]) + reach - first + q, q))
        new = np.array(found, np.int64).reshape(-1, 3)
        starts.append(new[:, 0])
        ends.append(new[:, 1])
        periods.append(new[:, 2])
        scale *= 2
    start, end, period = map(np.concatenate, (starts, ends, periods))
    # A multiple of a run's period gives the same stretch: the smallest period is the run's own.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    once &= end - start >= np.maximum(min_length, PERIODS * period)
    start, end, period = start[once], end[once], period[once]
    owner = np.searchsorted(borders, start, "right") - 1
    order = np.lexsort((period, start))
    return np.stack([owner, start - borders[owner], end - start, period], 1)[order]


def _numbered(view: memoryview, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as numbers, the texts' borders among them, and each number's word."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, at = [np.zeros(0, np.int32)], [0]
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        found = at[-1]
        rest = b""
        # In chunks, as single words take far more room than their number.
        for start in range(a, b, _CHUNK):
            piece = rest + bytes(view[start : min(start + _CHUNK, b)])
            words = piece.split()
            last = start + _CHUNK >= b
            rest = b"" if last or not words or piece[-1:].isspace() else words.pop()
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            found += len(words)
        at.append(found)
    return np.concatenate(parts), np.array(at, np.int64), list(number)


def _joined(numbers: np.ndarray, words: list[bytes]) -> bytes:
    return b" ".join(map(words.__getitem__, numbers.tolist()))


def collapse_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed: one row for each row of `docs`.

    Words are parted by ASCII white space and numbered from 0. A run is a stretch of at least
    `min_length` words and three periods that cannot be extended; `period` is its smallest. `collapsed`
    has the words that are in no run or, in every run around them, within the first period only, joined by
    one space. Null and empty texts have no words, no run and an empty `collapsed`; rows without an id,
    equal rows and rows of one id are judged each; an empty table gives an empty result; other columns
    are not read. A text is held by one task, with memory of about ten times its bytes.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, SLAB_BYTES):
            flat, borders = flat_bytes(batch.column(1))
            numbers, at, words = _numbered(memoryview(flat), borders)
            found = find_runs(numbers, at, min_length)
            owner, start, length, period = found.T
            first = at[owner] + start
            marks = np.zeros(len(numbers) + 1, np.int32)
            np.add.at(marks, first + period, 1)
            np.add.at(marks, first + length, -1)
            kept = np.cumsum(marks[:-1]) == 0
            texts = [
                _joined(numbers[a:b][kept[a:b]], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
            ]
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(kind)),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), runs, pa.array([t.decode() for t in texts], pa.string())],
                ["doc_id", "runs", "collapsed"],
            )

    texts = id_and_text(docs, id_column, text_column)
    schema = (
        f"doc_id {dict(texts.dtypes)['doc_id']}, runs array<struct<start: bigint, length: bigint, period: bigint>>,"
        " collapsed string"
    )
    return texts.mapInArrow(run, schema)


def run_digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (the first of equal ones; nulls for none),
    and the hashes of all runs and of the words kept."""
    # Runs are in order of start and period, so the first of equally strong ones stays.
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda held, r: F.when(r.length * held.period > held.length * r.period, r).otherwise(held),
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"),
                                                     F.concat(r.period.cast("string"), F.lit("\n"))))
    return collapsed.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text; where h = crc32 of the decimal id is divisible by 10, the words from number a on repeat
    the p words that begin there (g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8), n words).
    Rows without an id, and without words, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = id_and_text(docs, id_column, text_column).withColumn("h", h).withColumn("g", F.floor(h / 10))
    split = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    planted = (
        chosen.withColumn("words", F.when(F.col("h") % 10 == 0, split))
        .withColumn("n", F.size("words").cast("bigint"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
        .withColumn("head", F.slice("words", F.lit(1), F.col("a")))
        .withColumn("cycle", F.slice("words", F.col("a") + 1, F.col("p")))
        .withColumn("rest", F.expr("cast(n - a as int)"))
        .withColumn("turns", F.flatten(F.array_repeat("cycle", F.expr("cast(rest div p as int) + 1"))))
    )
    whole = F.concat(F.col("head"), F.slice("turns", F.lit(1), F.col("rest")))
    return planted.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
