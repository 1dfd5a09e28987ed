"""Date texts of the metadata formats as zone-less timestamps.

Nothing here depends on the session time zone, and nothing raises in ANSI mode: a text that is not
a date gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms that count as a date.
DAY = r"( [1-9]|\d{1,2})"
CAMERA_DATE = rf"(?!0000)(\d{{4}}):(\d{{1,2}}):{DAY}\s+(\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})"
SATELLITE_DAY = r"(?!0000)(\d{4}):(\d{1,2}):(\d{1,2})"
WHOLE_NUMBER = r"^\s*\+?\d+(_\d+)*\s*\z"
LOOSE_DAY = rf"(?!0000)(\d{{4}})-(\d{{1,2}})-{DAY}"
ISO_CLOCK = r"(\d\d)(?:(:?)(\d\d)(?:\6(\d\d))?)?(?:[.,](\d{1,6})\d*)?"
ISO_OFFSET = r"Z|[+-](?:[01]\d|2[0-2])(?::?\d\d(?::?\d\d)?)?(?:[.,]\d+)?|[+-]23(?::?[0-5]\d(?::?[0-5]\d)?)?(?:[.,]\d+)?"
ISO_DATE = rf"(?!0000)(\d{{4}})(-?)(\d\d)\2(\d\d)(?:.(?:{ISO_CLOCK}(?:{ISO_OFFSET})?))?"
ISO_WEEK = r"(?s)^(\d{4})(-?)W(\d\d)(?:\2(\d))?(?!\d)"


def rewritten(text: Column, pattern: str, replacement: str) -> Column:
    """The text in another form when all of it matches, else a text that is no date.

    One evaluation of the pattern tests and rewrites: a text that does not match keeps its mark.
    """
    return F.regexp_replace(F.concat(F.lit("#"), text), rf"(?s)^#(?:{pattern})\z", replacement)


def timestamp_of(year, month, day, hour=None, minute=None, second=None) -> Column:
    """Timestamp of its fields, null when they name no moment of the years 1 to 9999."""
    zero = F.lit(0)
    hour, minute, second = (zero if part is None else part for part in (hour, minute, second))
    return F.when(
        year.between(1, 9999) & (second < 60),
        F.try_make_timestamp_ntz(year, month, day, hour, minute, second),
    )


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it.

    The body is interpreted, not compiled, so this is for rare or small cases.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def camera_date(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as EXIF and TIFF write it; one-digit fields are allowed."""
    plain = rewritten(text, CAMERA_DATE, "$1-$2-$3 $4:$5:$6")
    return F.replace(plain, F.lit("- "), F.lit("-")).try_cast("timestamp_ntz")


def first_dated(*dated: tuple[str, Column]) -> Column:
    """Struct of date and source of the first column that holds a date."""
    source = F.lit(None).cast("string")
    for name, date in reversed(dated):
        source = F.when(date.isNotNull(), name).otherwise(source)
    return F.struct(F.coalesce(*[date for _, date in dated]).alias("date"), source.alias("source"))


def exif_date(original: Column, digitized: Column) -> Column:
    """Struct of date and source: the original date, else the digitized one."""
    both = F.struct(camera_date(original).alias("o"), camera_date(digitized).alias("d"))
    return bound(both, lambda date: first_dated(("exif_original", date["o"]), ("exif_digitized", date["d"])))


def gps_date(date_stamp: Column, time_stamp: Column) -> Column:
    """Satellite date and time; without a time it is midnight, fractions of a second are dropped."""
    has_clock = F.coalesce(F.size(time_stamp), F.lit(0)) > 0

    def clock(i):
        return F.when(has_clock, F.get(time_stamp, F.lit(i)).try_cast("int")).otherwise(F.lit(0))

    def number(text):
        return F.when(text.rlike(WHOLE_NUMBER), F.regexp_replace(text, r"[^0-9]", "")).try_cast("int")

    def moment(day):
        return timestamp_of(day[0], day[1], day[2], clock(0), clock(1), clock(2))

    day = rewritten(date_stamp, SATELLITE_DAY, "$1-$2-$3")
    usual = F.concat(day, F.lit(" "), F.concat_ws(":", *(clock(i).cast("string") for i in range(3))))
    parts = F.split(date_stamp, ":")
    unusual = F.when(F.size(parts) == 3, bound(F.transform(parts, number), moment))
    fits = ~has_clock | (F.size(time_stamp) == 3)
    return F.when(fits, F.coalesce(usual.try_cast("timestamp_ntz"), unusual))


def iso_date(text: Column, pattern: str = ISO_DATE) -> Column:
    """ISO 8601 text with at least a full date; a zone offset is read over, the wall clock kept."""
    is_week = text.contains("W") & text.rlike(ISO_WEEK)
    # The rare week form is interpreted, which keeps the compiled code of the usual forms small.
    full = rewritten(F.when(is_week, bound(text, _calendar_text)).otherwise(text), pattern, "$1-$3-$4 $5:$7:$8.$9")
    # Missing fields leave bare separators, which are filled up with zeros.
    for bare, filled in ((" :", " 00:"), ("::", ":00:"), (":.", ":00.")):
        full = F.replace(full, F.lit(bare), F.lit(filled))
    return F.rtrim(full, F.lit(".")).try_cast("timestamp_ntz")


def _calendar_text(text: Column) -> Column:
    """ISO week text with its calendar day; week 1 holds January 4th, a 53rd week December 28th."""

    def day_of(year, week, weekday):
        def midnight(month, day):
            return F.try_make_timestamp_ntz(year, F.lit(month), F.lit(day), *[F.lit(0)] * 3)

        valid = week.between(1, F.weekofyear(midnight(12, 28))) & weekday.between(1, 7)
        return F.when(valid, F.date_add(F.trunc(midnight(1, 4), "week"), (week - 1) * 7 + weekday - 1))

    def number(group, default):
        digits = F.regexp_extract(text, ISO_WEEK, group)
        return F.when(digits != "", digits.cast("int")).otherwise(default)

    day = day_of(number(1, 0), number(3, 0), number(4, 1)).cast("string")
    return F.concat(day, F.regexp_replace(text, ISO_WEEK, ""))


def xmp_date(text: Column) -> Column:
    """ISO date of an XMP element, or a plain day with one-digit fields.

    A final ``Z`` means a zero offset, so it may follow a bare day as well.
    """
    bare = F.btrim(text, F.lit(" \t\n\r\f\v"))
    day = F.replace(rewritten(bare, LOOSE_DAY, "$1-$2-$3"), F.lit("- "), F.lit("-"))
    with_zone = ISO_DATE.replace("(?:.(?:", "(?:Z|.(?:", 1)
    return F.coalesce(iso_date(bare, with_zone), day.try_cast("timestamp_ntz"))


def first_xmp_date(created: Column, photoshop_created: Column, modified: Column) -> Column:
    """Struct of date and source: the first of the three elements that holds a date."""
    both = F.struct(F.coalesce(xmp_date(created), xmp_date(photoshop_created)).alias("c"), xmp_date(modified).alias("m"))
    return bound(both, lambda date: first_dated(("xmp_create_date", date["c"]), ("xmp_modify_date", date["m"])))


def iso_text(date: Column) -> Column:
    """ISO 8601 text, with a fraction only where there is one."""
    micros = F.date_format(date, "SSSSSS")
    whole = F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
