"""Exact de-duplication by composable polynomial fingerprints.

A text is cut into chunks. A chunk's fingerprint is its bytes read as the digits of a number
to a fixed base, modulo two primes. Fingerprints compose: ``f(ab) = f(a) * base^len(b) + f(b)``,
so chunks are hashed in any order and a huge text needs no pass of its own. Texts of equal
length and fingerprint are only candidates: they are then compared chunk by chunk with the one
that would stay, and what differs is grouped again among itself.

No text of a group meets another in one task: a group's copies are dealt to salts of at most
`copies_per_salt`, each with the chunks of the row that stays, and are compared as chunk rows
streaming through a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import flat_bytes, id_and_text, slabs
from carelattice.session import cut_lineage

# Primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1540483477, 1228688033)
CHUNK = 1 << 16
#: Bytes of text hashed at once, with some ten numbers of eight bytes for each.
SLAB_BYTES = 512 << 10

_PRINTS = "doc_id bigint, print bigint, n_bytes bigint, text_sha256 string"
_ROW = ["doc_id", "print", "n_bytes", "text_sha256"]


def _powers(chunk: int, primes, bases) -> list[np.ndarray]:
    """base^0 .. base^chunk modulo each prime."""
    tables = []
    for prime, base in zip(primes, bases, strict=True):
        table = np.ones(chunk + 1, np.uint64)
        for i in range(1, chunk + 1):
            table[i] = int(table[i - 1]) * base % prime
        tables.append(table)
    return tables


def compose(left: int, right: int, right_length: int, prime: int, base: int) -> int:
    """The fingerprint of two pieces put together, from theirs."""
    return (left * pow(base, right_length, prime) + right) % prime


def fingerprints(flat: np.ndarray, borders: np.ndarray, chunk: int, powers, primes, bases) -> np.ndarray:
    """One number of 62 bits (or fewer, for smaller primes) for each text of a flat array."""
    lengths = np.diff(borders)
    pieces = np.maximum(1, -(-lengths // chunk))
    first = np.cumsum(pieces) - pieces
    of = np.repeat(np.arange(len(lengths)), pieces)
    starts = borders[of] + (np.arange(len(of)) - first[of]) * chunk
    ends = np.minimum(starts + chunk, borders[of + 1])
    sizes = ends - starts
    result = np.zeros(len(lengths), np.uint64)
    held = sizes > 0
    exponents = np.repeat(ends[held], sizes[held]) - 1 - np.arange(len(flat))
    for prime, base, table in zip(primes, bases, powers, strict=True):
        hashed = np.zeros(len(of), np.uint64)
        if len(flat):
            digits = table[exponents] * (flat.astype(np.uint64) + np.uint64(1))
            hashed[held] = np.add.reduceat(digits, starts[held]) % np.uint64(prime)
        whole = hashed[first].copy()
        for i in np.flatnonzero(pieces > 1):
            value = 0
            for j in range(first[i], first[i] + pieces[i]):
                value = compose(value, int(hashed[j]), int(sizes[j]), prime, base)
            whole[i] = value
        result = result * np.uint64(1 << 31) + whole
    return result


def text_prints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES,
) -> DataFrame:
    """doc_id, print, n_bytes, text_sha256 of every row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(chunk, primes, bases)
        for batch in slabs(batches, SLAB_BYTES):
            flat, borders = flat_bytes(batch.column(1))
            view = memoryview(flat)
            prints = fingerprints(flat, borders, chunk, powers, primes, bases)
            digests = [
                hashlib.sha256(view[a:b]).hexdigest()
                for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(prints.astype(np.int64)),
                    pa.array(np.diff(borders)), pa.array(digests, pa.string()),
                ],
                ["doc_id", "print", "n_bytes", "text_sha256"],
            )

    texts = id_and_text(docs, id_column, text_column)
    return texts.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, _PRINTS)


def _differing(docs: DataFrame, candidates: DataFrame, chunk: int, copies_per_salt: int) -> DataFrame:
    """The candidates (doc_id, print, n_bytes, text_sha256) whose text is not that of the row that stays.

    An id may stand for several texts, so a candidate takes back the one of its digest.
    """
    # A merge join at every size: the texts are dealt by id once, the candidates may be many.
    texts = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).hint("merge")
    holding = texts.join(candidates, "doc_id").select(
        *_ROW, "keep_id", "keep_sha256",
        ((F.col("doc_id") == F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha256"))).alias("stays"),
        F.ceil(F.col("group_size") / copies_per_salt).cast("int").alias("salts"),
        F.col("text").cast("binary").alias("bytes"),
    ).filter((F.length("bytes") == F.col("n_bytes")) & (F.sha2("bytes", 256) == F.col("text_sha256")))
    # The row that stays goes to every salt, a copy to one.
    salted = holding.withColumn(
        "salt",
        F.explode(
            F.when(F.col("stays"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
            )
        ),
    )
    pieces = salted.select(
        *_ROW, "keep_id", "keep_sha256", "stays", "salt",
        F.posexplode(
            F.expr(
                f"transform(sequence(0L, greatest(n_bytes - 1, 0L) div {chunk}),"
                f" i -> substring(bytes, int(i * {chunk}) + 1, {chunk}))"
            )
        ).alias("piece", "content"),
    )
    # Chunks stream by in order, the one that stays first; no group is held.
    meeting = Window.partitionBy("print", "n_bytes", "keep_id", "keep_sha256", "piece", "salt").orderBy(F.desc("stays"))
    return (
        pieces.withColumn("kept_content", F.first("content").over(meeting))
        .filter("content != kept_content")
        .select(*_ROW)
        .distinct()
    )


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES,
    copies_per_salt: int = 256,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    Of equal texts the row with the largest id stays. A null text is an empty one, and empty
    texts equal each other. Repeated rows (equal id and text) count in `group_size` and get
    equal answers; rows of one id with different texts are judged each by its own text. A row without an id cannot be named: it is a group of its own and stays.
    An empty table gives an empty result. Other columns are not read.
    """
    prints = cut_lineage(text_prints(docs, id_column, text_column, chunk, primes, bases), "prints")
    texts = id_and_text(docs, id_column, text_column)
    key = ["print", "n_bytes"]
    pending = prints.filter("doc_id is not null").select(*_ROW)
    rounds = []
    while True:
        groups = cut_lineage(
            pending.groupBy(*key)
            .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "text_sha256")).alias("keep"))
            .filter("group_size > 1")
            .select(*key, "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_sha256").alias("keep_sha256")),
            "print-groups",
        )
        candidates = cut_lineage(pending.distinct().join(groups, key), "copies")
        differing = cut_lineage(_differing(texts, candidates, chunk, copies_per_salt), "differing")
        if differing.isEmpty():
            rounds.append(candidates)
            break
        # A collision: what differs from the row that stays is grouped anew, repeated rows as often as they are.
        apart = pending.join(differing, _ROW, "left_semi")
        lost = apart.groupBy(*key).agg(F.count("*").alias("lost"))
        rounds.append(
            candidates.join(differing, _ROW, "left_anti")
            .join(lost, key, "left")
            .withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))
            .drop("lost")
        )
        pending = cut_lineage(apart, "collided")
    classes = rounds[0]
    for further in rounds[1:]:
        classes = classes.unionByName(further)
    return prints.join(classes, _ROW, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
