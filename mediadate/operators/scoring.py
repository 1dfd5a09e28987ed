"""One date per file from its signals, with a confidence and an explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate import settings
from mediadate.operators.signals import collect_signals


def timestamp_literal(text: str) -> Column:
    """Zone-less timestamp constant."""
    return F.lit(text).cast("timestamp_ntz")


def within_days(other: Column, primary: Column, days: int) -> Column:
    """Whether the whole-day difference, rounded down, is at most ``days`` either way.

    Rounding down makes the window lopsided: ``days`` before, almost ``days + 1`` after.
    """
    before = F.expr(f"INTERVAL '{int(days)}' DAY")
    after = F.expr(f"INTERVAL '{int(days) + 1}' DAY")
    return (other >= primary - before) & (other < primary + after)


def score_dates(
    with_signals: DataFrame,
    *,
    as_of: Column,
    threshold_days: int = 1,
    labels: dict[str, str] = settings.SOURCE_LABELS,
) -> DataFrame:
    """Add the date conclusion to rows that carry ``signals`` (see ``gather_signals``).

    The strongest signal gives the date, the first gathered one on a tie. Every other signal
    confirms or disputes it. Any source may take part: a new one is one more array element. Works
    inside the row, so it needs no shuffle.
    """
    signals = F.col("signals")
    ranked = F.transform(
        signals, lambda s: F.struct(s["base_confidence"].alias("base"), (-s["seq"]).alias("order"), s.alias("signal"))
    )
    label_map = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])

    def label(source):
        return F.coalesce(F.try_element_at(label_map, source), source)

    def named(rows):
        return F.array_join(F.transform(rows, lambda s: label(s["source"])), ", ")

    primary = F.col("_primary")
    others = F.filter(signals, lambda s: s["seq"] != primary["seq"])
    agrees = lambda s: within_days(s["date"], primary["date"], threshold_days)
    split = with_signals.withColumn("_primary", F.array_max(ranked)["signal"])
    split = split.withColumns(
        {"_agree": F.filter(others, agrees), "_dispute": F.filter(others, lambda s: ~agrees(s))}
    )
    agree, dispute = F.col("_agree"), F.col("_dispute")

    earliest = timestamp_literal(settings.EARLIEST_PLAUSIBLE)
    implausible = (primary["date"] < earliest) | (primary["date"] > as_of)
    raw = (
        primary["base_confidence"]
        + settings.AGREEMENT_BONUS * F.size(agree)
        - settings.MISMATCH_PENALTY * F.size(dispute)
    )
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    confidence = F.when(implausible, F.least(clamped, F.lit(settings.IMPLAUSIBLE_CAP))).otherwise(clamped)
    reason = F.concat(
        label(primary["source"]),
        F.when(F.size(agree) > 0, F.concat(F.lit(settings.REASON_CONFIRMED), named(agree))).otherwise(""),
        F.when(F.size(dispute) > 0, F.concat(F.lit(settings.REASON_DISAGREES), named(dispute))).otherwise(""),
        F.when(implausible, settings.REASON_IMPLAUSIBLE).otherwise(""),
    )
    filesystem = F.filter(signals, lambda s: s["source"] == "filesystem_fallback")
    # greatest and least pass over nulls, so files without evidence need a branch of their own.
    known = F.when(primary.isNull(), F.lit(0)).otherwise(confidence)
    judged = split.withColumn("_confidence", known.cast("int"))
    conclusion = F.struct(
        primary["date"].alias("date_taken"),
        primary["source"].alias("date_source"),
        F.get(filesystem, F.lit(0))["date"].alias("filesystem_creation_date"),
        F.col("_confidence").alias("confidence"),
        F.coalesce(reason, F.lit(settings.REASON_NO_EVIDENCE)).alias("date_reason"),
        (F.col("_confidence") < settings.UNCERTAIN_BELOW).cast("int").alias("date_uncertain"),
    )
    # As a generated row, so that a later filter on the conclusion is not pushed below the parsing,
    # where it would parse everything a second time.
    return judged.select(*with_signals.columns, F.inline(F.array(conclusion)))


def score_dates_long(files: DataFrame, long_signals: DataFrame, *, as_of: Column, **options) -> DataFrame:
    """Conclusion per ``file_id`` of ``files`` from signals in long form.

    Files without any signal are kept, with the no-evidence conclusion.
    """
    wide = files.join(collect_signals(long_signals), "file_id", "left")
    none = F.array().cast(wide.schema["signals"].dataType)
    wide = wide.withColumn("signals", F.coalesce("signals", none))
    return score_dates(wide, as_of=as_of, **options).drop("signals")
