"""Secret scans over a trigram index.

From each rule's pattern follows a Boolean query of trigrams that every match must hold. Each
slab of documents gets an inverted index of the trigrams that some rule asks for; a rule's query
intersects and unites posting lists, and only the documents left are searched with the pattern.
A rule without mandatory trigrams searches every document. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs
from carelattice.llm.wordarrays import lower_ascii

#: Strings that one stretch of a pattern may stand for before its trigrams are taken.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has `at_least` characters."""

    kind: str
    pattern: str
    at_least: int = 0
    group: int = 0
    ignore_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


# The kinds and their patterns. A run of 24 or more hexadecimal digits is the same
# as a run of any length that has 24, so the length stands in the pattern.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6, 2, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is a trigram, True (no demand), or ("all" | "any", parts).
Query = bytes | bool | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    neutral = kind == "all"
    if not neutral and any(part is True for part in parts):
        return True
    rest = [part for part in dict.fromkeys(parts) if part is not True]
    if not rest:
        return True
    return rest[0] if len(rest) == 1 else (kind, tuple(rest))


def _of_strings(strings: set[str]) -> Query:
    """Some of the strings: any of them, each with all its trigrams."""
    parts: list[Query] = []
    for text in sorted(strings):
        raw = text.encode()
        grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
        parts.append(_both("all", grams) if grams else True)
    return _both("any", parts)


def _characters(members) -> set[str] | None:
    """The letters of a small character class, folded; None if it is large or negated."""
    found: set[str] = set()
    for op, value in members:
        if op is ops.LITERAL:
            found.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """All strings a sequence can be, if they are few, and a query that it implies."""
    stretch: set[str] = {""}
    parts: list[Query] = []
    exact = True

    def close() -> None:
        nonlocal stretch, exact
        parts.append(_of_strings(stretch))
        stretch, exact = {""}, False

    for op, value in items:
        strings: set[str] | None = None
        inner: Query = True
        if op is ops.LITERAL:
            strings = {chr(value).lower()}
        elif op is ops.IN:
            strings = _characters(value)
        elif op is ops.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif op is ops.BRANCH:
            walked = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in walked):
                strings = set().union(*(s for s, _ in walked))
            else:
                inner = _both("any", [q if s is None else _of_strings(s) for s, q in walked])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            least, most, repeated = value
            once, inner = _walk(repeated)
            if once is not None and most == 1:
                strings = once | ({""} if least == 0 else set())
            elif once is not None and least:
                inner = _of_strings(once)
            if least == 0:
                inner = True
        elif op is ops.AT:
            strings = {""}
        if strings is not None and len(strings) * len(stretch) <= MOST_STRINGS:
            stretch = {a + b for a in stretch for b in strings}
        else:
            close()
            if strings is not None and len(strings) <= MOST_STRINGS:
                stretch = set(strings)
            parts.append(inner)
    if exact:
        return stretch, _of_strings(stretch)
    parts.append(_of_strings(stretch))
    return None, _both("all", parts)


def trigram_query(rule: Rule) -> Query:
    """What any match of the rule must hold, in trigrams of the text with A-Z lower-cased."""
    return _walk(parser.parse(rule.pattern, rule.flags))[1]


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    if isinstance(query, tuple):
        return set().union(*map(trigrams_of, query[1]))
    return set()


def _code(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


class TrigramIndex:
    """Postings of the wanted trigrams over the texts of one slab."""

    def __init__(self, flat: np.ndarray, borders: np.ndarray, wanted: np.ndarray):
        self.count = len(borders) - 1
        folded = lower_ascii(flat).astype(np.int32)
        codes = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
        at = np.flatnonzero(wanted[codes]) if len(codes) else np.zeros(0, np.int64)
        texts = np.searchsorted(borders, at, side="right") - 1
        whole = at + 3 <= borders[texts + 1]  # not over the end of a text
        keys = np.unique(codes[at[whole]].astype(np.int64) << 32 | texts[whole])
        self.codes, self.texts = keys >> 32, keys & 0xFFFFFFFF

    def postings(self, gram: bytes) -> np.ndarray:
        a, b = np.searchsorted(self.codes, [_code(gram), _code(gram) + 1])
        return self.texts[a:b]

    def candidates(self, query: Query) -> np.ndarray:
        """The texts that fulfil the query, ascending."""
        if query is True:
            return np.arange(self.count)
        if isinstance(query, bytes):
            return self.postings(query)
        lists = [self.candidates(part) for part in query[1]]
        found = lists[0]
        for other in lists[1:]:
            if query[0] == "all":
                found = np.intersect1d(found, other, assume_unique=True)
            else:
                found = np.union1d(found, other)
        return found


def secret_spans(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id and `spans` (kind, start, end in code points, end exclusive) of every row.

    Per kind the matches are the leftmost that do not overlap; those too short are dropped after
    matching. Spans of different kinds may overlap; they are ordered by start, then as the rules
    are listed. A null or empty text has none, repeated rows are answered each, an empty table
    gives an empty result, and other columns are not read.
    """
    demands = [trigram_query(rule) for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << 24, bool)
        for demand in demands:
            wanted[[_code(gram) for gram in trigrams_of(demand)]] = True
        patterns = [re.compile(rule.pattern, rule.flags) for rule in rules]
        for batch in slabs(batches, 4 << 20):
            flat, borders = flat_bytes(batch.column(1))
            index = TrigramIndex(flat, borders, wanted)
            view = memoryview(flat)
            found: dict[int, list[tuple[int, int, int]]] = {}
            texts: dict[int, str] = {}
            for order, (rule, pattern, demand) in enumerate(zip(rules, patterns, demands, strict=True)):
                scanned = demand is True
                for i in index.candidates(demand).tolist():
                    text = texts.get(i)
                    if text is None:
                        text = str(view[borders[i] : borders[i + 1]], "utf-8")
                        if not scanned:
                            texts[i] = text
                    for match in pattern.finditer(text):
                        if len(match[rule.group]) >= rule.at_least:
                            found.setdefault(i, []).append((match.start(), order, match.end()))
            spans = [
                [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(found.get(i, ()))]
                for i in range(batch.num_rows)
            ]
            kind = pa.list_(
                pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"]
            )

    texts = id_and_text(docs, id_column, text_column)
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>"
    )


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = ", ".join(f"'{rule.kind}'" for rule in BASE_RULES)
    listed = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = '{rule.kind}')) as bigint)").alias(f"n_{rule.kind}")
        for rule in BASE_RULES
    ]
    chosen = listed.format(f"filter(spans, s -> s.kind in ({base}))")
    return spans.select(
        "doc_id", *counts, F.sha2(F.expr(chosen), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )
