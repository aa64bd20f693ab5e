"""HL7 v2 messages as column expressions: no shuffle, no Python in the path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelattice.functions.text import strip

# The characters that end a line. A carriage return with a line feed
# makes one more line, which is blank and skipped.
_LINE_BREAK = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# Record key -> (segment, field, last field the segment must reach).
# A visit segment yields its location only when it also reaches the provider field.
RECORD_FIELDS = {
    "mrn": ("PID", 3, 3),
    "name": ("PID", 5, 5),
    "dob": ("PID", 7, 7),
    "provider": ("PV1", 7, 7),
    "location": ("PV1", 3, 7),
}

# Item list -> (segment, field).
ITEM_FIELDS = {"allergies": ("AL1", 3), "medications": ("RXA", 5)}

# Fixed value: largest accepted message, in UTF-8 bytes.
MAX_MESSAGE_BYTES = 262_144


def segments(message: Column) -> Column:
    """Message -> array of segments, each an array of its ``|`` fields."""
    lines = F.transform(F.split(message, _LINE_BREAK), strip)
    return F.transform(F.filter(lines, lambda line: line != ""), lambda line: F.split(line, "\\|"))


def segment_name(segment: Column) -> Column:
    return F.get(segment, F.lit(0))


def record_field(segs: Column, key: str) -> Column:
    """The value of the last segment of the right name that is long enough."""
    name, index, reach = RECORD_FIELDS[key]
    fitting = F.filter(segs, lambda s: (segment_name(s) == name) & (F.size(s) > reach))
    return F.get(F.try_element_at(fitting, F.lit(-1)), F.lit(index))


def items(segs: Column, key: str) -> Column:
    """Display texts, in segment order: the second component, else the first."""
    name, index = ITEM_FIELDS[key]
    fitting = F.filter(segs, lambda s: (segment_name(s) == name) & (F.size(s) > index))

    def display(segment: Column) -> Column:
        parts = F.split(F.get(segment, F.lit(index)), "\\^")
        second = F.get(parts, F.lit(1))
        return F.when(second != "", second).otherwise(F.get(parts, F.lit(0)))

    return F.filter(F.transform(fitting, display), lambda item: item != "")


def is_unread(segment: Column) -> Column:
    """True when the record mapping takes nothing from this segment."""
    name = segment_name(segment)
    shortest = {"PID": 3, "PV1": 7}
    read = F.lit(False)
    for known, reach in shortest.items():
        read = read | ((name == known) & (F.size(segment) > reach))
    return ~read
