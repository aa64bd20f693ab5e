"""Text helpers shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A backslash that escapes an ordinary character stands for that character; Spark
# accepts it only before a wildcard or another backslash, so it is dropped.
_LOOSE_ESCAPE = r"(\\[\\%_])|\\([^\\%_])"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def contains_pattern(q: str) -> str:
    """Substring pattern for ILIKE. Wildcards inside `q` stay live."""
    return "%" + re.sub(_LOOSE_ESCAPE, lambda m: m.group(1) or m.group(2), q, flags=re.S) + "%"


def contains_pattern_of(q: Column) -> Column:
    """The same pattern built from a column."""
    return F.concat(F.lit("%"), F.regexp_replace(q, "(?s)" + _LOOSE_ESCAPE, "$1$2"), F.lit("%"))


def status_not_in(status: Column, *closed: str) -> Column:
    """Lower-cased status outside `closed`; a missing status is kept."""
    return F.coalesce(~F.lower(status).isin(*closed), F.lit(True))


def is_result(reference_range: Column) -> Column:
    """A record counts as a result when it carries a reference range."""
    return F.coalesce(reference_range != "", F.lit(False))


def live_rows(deleted_at: Column) -> Column:
    return deleted_at.isNull()


# Badge variant by status.
STATUS_VARIANTS = {
    "ok": [
        "confirmed", "booked", "scheduled", "completed", "available", "open", "active",
        "fulfilled", "normal",
    ],
    "warn": ["pending", "requested", "in-progress", "in_progress", "waitlist", "held"],
    "bad": [
        "cancelled", "canceled", "denied", "abnormal", "high", "low", "critical", "expired",
    ],
    "info": ["booking"],
}


def status_variant(status: Column) -> Column:
    """ok / warn / bad / info for a known status, neutral otherwise."""
    key = strip(F.lower(status))
    variant = F.lit("neutral")
    for name, values in STATUS_VARIANTS.items():
        variant = F.when(key.isin(*values), F.lit(name)).otherwise(variant)
    return variant


def split_items(text: Column, nothing: tuple[str, ...] = ("none known",)) -> Column:
    """Comma-separated free text -> distinct trimmed lower-case items."""
    items = F.transform(F.split(text, ","), lambda item: F.lower(strip(item)))
    return F.array_distinct(
        F.filter(items, lambda item: (item != "") & ~item.isin(*nothing))
    )


# Shapes of the sensitive values that are looked for and masked.
PHI_PATTERNS = {
    "ssn": "\\b(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})\\b",
    "phone": "(?:\\([0-9]{3}\\) ?|\\b[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}\\b",
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}",
    "dob": "\\b(?:19|20)[0-9]{2}(?:-[01][0-9]-|[01][0-9])[0-3][0-9]\\b",
}

# What replaces each kind, e-mails first; an SSN keeps its last four digits.
_MASKS = [
    ("email", PHI_PATTERNS["email"], "[email]"),
    ("ssn", "\\b(?:[0-9]{3}-[0-9]{2}-|[0-9]{5})([0-9]{4})\\b", "•••-••-$1"),
    ("phone", PHI_PATTERNS["phone"], "[phone]"),
    ("dob", PHI_PATTERNS["dob"], "[date]"),
]


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap test that spares most texts the regex: a sign that every match contains."""
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]{3}")


def find_phi(text: Column, kind: str) -> Column:
    """All values of one kind in the text."""
    every = F.regexp_extract_all(text, F.lit(PHI_PATTERNS[kind]), F.lit(0))
    return F.when(_may_hold(text, kind), every)


def mask_ssn(ssn: Column) -> Column:
    return F.when(ssn != "", F.concat(F.lit("•••-••-"), F.right(ssn, F.lit(4))))


def redact(text: Column) -> Column:
    """Mask every e-mail, SSN, phone number and date of birth in free text."""
    for kind, regex, mask in _MASKS:
        masked = F.regexp_replace(text, regex, mask)
        text = F.when(_may_hold(text, kind), masked).otherwise(text)
    return text
