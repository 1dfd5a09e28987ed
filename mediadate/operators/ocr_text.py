"""From OCR words to the accepted date stamp of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate import settings
from mediadate.functions import stamps
from mediadate.operators.skew import spread_join

# The order in which corners, rotations and variants are looked at.
CORNERS = ("bottom_right", "bottom_left", "top_right", "top_left")
ROTATIONS = (0, 90, 180, 270)
VARIANTS = ("raw", "otsu")


def attempt_order(corner: Column, rotation: Column, variant: Column) -> Column:
    """Position of an attempt among the 32 of a picture."""

    def place(column, values):
        return F.array_position(F.array(*[F.lit(v) for v in values]), column) - 1

    per_corner = len(ROTATIONS) * len(VARIANTS)
    return place(corner, CORNERS) * per_corner + place(rotation, ROTATIONS) * len(VARIANTS) + place(variant, VARIANTS)


def attempt_texts(words: DataFrame, keys: tuple[str, ...] = ("file_id", "attempt_seq")) -> DataFrame:
    """Text and mean confidence of each attempt from its words.

    Blank words do not count at all, words without a confidence (negative) only in the text. An
    attempt is one line of a picture, so its words fit a row by nature.
    """
    spoken = F.regexp_replace("text", r"^\s+|\s+\z", "") != ""
    trusted = F.when(spoken & (F.col("conf") >= 0), F.col("conf"))
    word = F.when(spoken, F.struct("word_seq", "text"))
    gathered = words.groupBy(*keys).agg(F.array_sort(F.collect_list(word)).alias("_words"), F.avg(trusted).alias("_mean"))
    return gathered.select(
        *keys,
        F.array_join(F.col("_words.text"), " ").alias("raw_text"),
        F.coalesce("_mean", F.lit(0.0)).alias("ocr_confidence"),
    )


def read_stamps(attempts: DataFrame, as_of: Column) -> DataFrame:
    """Attempts with the date their text holds and whether it is trusted.

    The first form whose match is a calendar day decides. A day before 1900 or after ``as_of`` is a
    misread digit, so it ends the search without a date. Digits without punctuation need the higher
    confidence.
    """
    forms = range(len(stamps.STAMP_FORMS))
    read = attempts.withColumns({f"_text{i}": stamps.stamp_reading(F.col("raw_text"), i) for i in forms})
    read = read.withColumns({f"_day{i}": stamps.reading_day(F.col(f"_text{i}")) for i in forms})
    deciding = F.coalesce(*[F.when(F.col(f"_day{i}").isNotNull(), F.col(f"_text{i}")) for i in forms])
    read = read.withColumns({"_day": F.coalesce(*[f"_day{i}" for i in forms]), "_match": stamps.reading_match(deciding)})
    plausible = (F.year("_day") >= settings.STAMP_EARLIEST_YEAR) & (F.col("_day") <= as_of)
    punctuated = F.coalesce(plausible & F.col("_match").rlike(stamps.PUNCTUATION), F.lit(False))
    read = read.withColumns({"stamp_date": F.when(plausible, F.col("_day")), "punctuated": punctuated})
    needed = F.when(F.col("punctuated"), settings.STAMP_MIN_CONFIDENCE).otherwise(settings.STAMP_MIN_CONFIDENCE_BARE)
    accepted = F.col("stamp_date").isNotNull() & (F.col("ocr_confidence") >= needed)
    return read.select(
        *attempts.columns, "stamp_date", "punctuated", F.coalesce(accepted, F.lit(False)).alias("accepted")
    )


def first_accepted(attempts: DataFrame, as_of: Column) -> DataFrame:
    """Per file the first trusted attempt, with null columns where there is none, and how many
    attempts were looked at up to it.

    Two aggregations with map-side partial results; attempts are never collected.
    """
    read = read_stamps(attempts, as_of)
    details = [c for c in ("corner", "rotation", "variant", "raw_text") if c in attempts.columns]
    shown = F.struct(
        "attempt_seq", "stamp_date", *details, F.bround("ocr_confidence", 1).alias("ocr_confidence")
    )
    best = read.groupBy("file_id").agg(
        F.min_by(F.when(F.col("accepted"), shown), F.when(F.col("accepted"), F.col("attempt_seq"))).alias("_best")
    )
    stops = best.select("file_id", F.col("_best.attempt_seq").alias("_stop"))
    checked = spread_join(read.select("file_id", "attempt_seq"), stops, "file_id", "attempt_seq")
    looked_at = F.count_if(F.col("_stop").isNull() | (F.col("attempt_seq") <= F.col("_stop")))
    counted = checked.groupBy("file_id").agg(looked_at.alias("checked"))
    return best.join(counted, "file_id").select("file_id", "_best.*", "checked").withColumnRenamed("stamp_date", "ocr_date")


def checked_attempts(attempts: DataFrame, as_of: Column) -> DataFrame:
    """The attempts looked at: all up to the first trusted one, or all."""
    read = read_stamps(attempts, as_of)
    stop = read.filter("accepted").groupBy("file_id").agg(F.min("attempt_seq").alias("_stop"))
    kept = read.join(stop, "file_id", "left").filter("_stop is null or attempt_seq <= _stop")
    return kept.select(*[c for c in attempts.columns if c != "ocr_confidence"], F.bround("ocr_confidence", 1).alias("ocr_confidence"))
