"""HL7 feed operators over a table of messages (`message_id`, `message`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.functions import hl7
from carelattice.functions.text import is_blank


def validate_hl7(messages: DataFrame) -> DataFrame:
    """Messages with `reject_reason`: null, `empty` or `too_large`."""
    message = F.col("message")
    return messages.withColumn(
        "reject_reason",
        F.when(is_blank(message), F.lit("empty")).when(
            F.octet_length(message) > hl7.MAX_MESSAGE_BYTES, F.lit("too_large")
        ),
    )


def _kept(messages: DataFrame) -> list[str]:
    return [c for c in messages.columns if c != "message"]


def with_segments(messages: DataFrame) -> DataFrame:
    """The messages with `_segments` in place of their text: split once, read often."""
    return messages.select(*_kept(messages), hl7.segments(F.col("message")).alias("_segments"))


def records_of(split: DataFrame, with_items: bool = False) -> DataFrame:
    """One record per message of `with_segments`."""
    segs = F.col("_segments")
    nothing = F.array().cast("array<string>")
    return split.select(
        *[c for c in split.columns if c != "_segments"],
        *[hl7.record_field(segs, key).alias(key) for key in hl7.RECORD_FIELDS],
        *[
            (hl7.items(segs, key) if with_items else nothing).alias(key)
            for key in hl7.ITEM_FIELDS
        ],
    )


def parse_hl7(messages: DataFrame, with_items: bool = False) -> DataFrame:
    """One record per message, in a single pass.

    The item lists are empty, as the record mapping never reads their segments;
    `with_items` fills them.
    """
    return records_of(with_segments(messages), with_items)


def hl7_segments(messages: DataFrame) -> DataFrame:
    """One row per segment: its position in the message, name and fields."""
    kept = _kept(messages)
    return messages.select(
        *kept, F.posexplode(hl7.segments(F.col("message"))).alias("position", "fields")
    ).withColumn("segment", hl7.segment_name(F.col("fields")))


def hl7_clinical_items(messages: DataFrame) -> DataFrame:
    """Allergies and medications of each message, in segment order."""
    return with_segments(messages).select(
        *_kept(messages),
        *[hl7.items(F.col("_segments"), key).alias(key) for key in hl7.ITEM_FIELDS],
    )


def hl7_unmapped_segments(messages: DataFrame) -> DataFrame:
    """How many segments of each name the record mapping takes nothing from."""
    unread = F.filter(hl7.segments(F.col("message")), hl7.is_unread)
    return (
        messages.select(F.explode(F.transform(unread, hl7.segment_name)).alias("segment"))
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n_segments"))
    )
