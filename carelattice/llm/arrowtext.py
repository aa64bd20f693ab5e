"""Text columns inside Arrow batches as flat byte arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the two columns an operator reads; a null text counts as empty."""
    return docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 borders of its texts."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, kind)[column.offset : column.offset + len(column) + 1]
    borders = borders.astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[borders[0] : borders[-1]], borders - borders[0]


def slabs(
    batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20, max_rows: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `max_bytes` of text (column 1) and `max_rows`, to bound memory.

    A slice holds at least one row, so one longer text is a slice of its own.
    """
    for batch in batches:
        _, borders = flat_bytes(batch.column(1))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(borders, borders[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), start + max_rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def crc_fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo `folds`."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def rows_where(docs: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], text_column: str) -> DataFrame:
    """The whole rows that a task's test keeps, in one pass without a shuffle.

    `start` runs once for each task and gives the test: it takes a batch with the texts (null as
    empty) in column 1 and returns a flag for each row.
    """
    names = docs.columns
    place = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            texts = batch.column(place).fill_null("")
            done = 0
            numbers = pa.array(np.arange(batch.num_rows))
            rows = pa.RecordBatch.from_arrays([numbers, texts], ["row", "text"])
            for part in slabs(iter([rows]), 1 << 20):
                flags = pa.array(np.asarray(keep(part), bool))
                yield batch.slice(done, part.num_rows).filter(flags)
                done += part.num_rows

    return docs.mapInArrow(run, docs.schema)
