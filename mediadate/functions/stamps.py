"""Dates printed into a picture, as read by OCR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms of a stamp, in the order they are tried, and the groups that hold
# year, month and day.
STAMP_FORMS = (
    (r"'?(\d{4}|\d{2})[\s\-\./](\d{1,2})[\s\-\./](\d{1,2})\b", (2, 3, 4)),
    (r"\b(\d{1,2})[\s\-\./](\d{1,2})[\s\-\./]'?(\d{4}|\d{2})\b", (4, 2, 3)),
    (r"\b(\d{1,2})[\s\-\./](\d{1,2})[\s\-\./]'?(\d{4}|\d{2})\b", (4, 3, 2)),
)
PUNCTUATION = r"[-./']"
LAST_CENTURY, THIS_CENTURY = r"^(?:00)?(3[1-9]|[4-9]\d)-", r"^(?:00)?([0-2]\d|30)-"


def stamp_reading(text: Column, form: int) -> Column:
    """First match of a form as ``year-month-day=match``; some other text without a match."""
    pattern, (year, month, day) = STAMP_FORMS[form]
    found = F.regexp_replace(
        F.concat(F.lit("#"), text), rf"(?s)^#.*?({pattern}).*\z", f"${year}-${month}-${day}=$1"
    )
    return F.regexp_replace(F.regexp_replace(found, LAST_CENTURY, "19$1-"), THIS_CENTURY, "20$1-")


def reading_day(reading: Column) -> Column:
    """The day of a reading, null when it is none of the calendar."""
    return F.substring_index(reading, "=", 1).try_cast("timestamp_ntz")


def reading_match(reading: Column) -> Column:
    """The matched text of a reading."""
    return F.substring_index(reading, "=", -1)
