"""Date conclusions of the scenario table, and agreement against plain date arithmetic."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediadate import schemas, settings
from mediadate.operators.scoring import score_dates, timestamp_literal

NOW = datetime(2024, 6, 15, 12, 0, 0, 500000)
FILE = ("filesystem_fallback", NOW)
SEQ = {s: i for i, s in enumerate(
    ["exif_gps", "exif_original", "exif_digitized", "xmp_create_date", "xmp_modify_date", "tiff_datetime", "ocr_corner_stamp", "filesystem_fallback"])}


def ago(days=0.0, **more):
    return (NOW - timedelta(days=days, **more)).replace(microsecond=0)


CASES = {
    "match": ([("exif_original", ago())], "exif_original", 100),
    "mismatch": ([("exif_original", ago(30))], "exif_original", 70),
    "no exif": ([], "filesystem_fallback", 30),
    "too old": ([("exif_original", datetime(1960, 1, 1))], "exif_original", 5),
    "future": ([("exif_original", ago(-30))], "exif_original", 5),
    "gps agree 1": ([("exif_gps", ago(1)), ("exif_original", ago(1))], "exif_gps", 100),
    "gps agree 5": ([("exif_gps", ago(5)), ("exif_original", ago(5))], "exif_gps", 78),
    "gps disagree 1": ([("exif_gps", ago(1)), ("exif_original", ago(700))], "exif_gps", 78),
    "gps disagree 5": ([("exif_gps", ago(5)), ("exif_original", ago(700))], "exif_gps", 48),
    "gps only 1": ([("exif_gps", ago(1))], "exif_gps", 100),
    "gps only 5": ([("exif_gps", ago(5))], "exif_gps", 73),
    "xmp agree 5": ([("exif_original", ago(5)), ("xmp_create_date", ago(5))], "exif_original", 75),
    "xmp disagree": ([("exif_original", ago(700)), ("xmp_create_date", ago(5))], "exif_original", 45),
    "xmp only 1": ([("xmp_create_date", ago(1))], "xmp_create_date", 85),
    "xmp only 5": ([("xmp_create_date", ago(5))], "xmp_create_date", 55),
    "xmp modify": ([("xmp_modify_date", ago(1))], "filesystem_fallback", 5),
    "tiff": ([("tiff_datetime", ago(5))], "tiff_datetime", 65),
    "47 h": ([("exif_original", NOW - timedelta(hours=47))], "exif_original", 100),
    "48 h": ([("exif_original", NOW - timedelta(hours=48))], "exif_original", 70),
}


def conclusions(spark, files, **options):
    rows = [
        (name, [(SEQ[s], s, d, settings.BASE_CONFIDENCE[s]) for s, d in signals])
        for name, signals in files.items()
    ]
    frame = spark.createDataFrame(rows, f"file_id string, signals array<{schemas.SIGNAL}>")
    scored = score_dates(frame, as_of=timestamp_literal(str(NOW)), **options)
    return {r.file_id: r for r in scored.collect()}


def test_scenarios(spark):
    found = conclusions(spark, {name: [*signals, FILE] for name, (signals, _, _) in CASES.items()})
    assert {n: (r.date_source, r.confidence) for n, r in found.items()} == {n: c[1:] for n, c in CASES.items()}
    assert all(r.date_uncertain == int(r.confidence < 50) for r in found.values())
    assert found["too old"].date_reason == (
        "EXIF (DateTimeOriginal) -- disagrees with filesystem creation date"
        " -- date is implausible (before cameras existed, or in the future)"
    )


def test_no_signals(spark):
    row = conclusions(spark, {"none": []})["none"]
    assert (row.date_taken, row.date_source, row.confidence, row.date_uncertain) == (None, None, 0, 1)
    assert row.date_reason == settings.REASON_NO_EVIDENCE


@pytest.mark.parametrize("days", [0, 1, 3])
def test_agreement_rounds_days_down(spark, days):
    offsets = [timedelta(hours=h, microseconds=u) for h in range(-100, 101, 12) for u in (-1, 0, 1)]
    files = {str(i): [("exif_original", NOW), ("filesystem_fallback", NOW + o)] for i, o in enumerate(offsets)}
    found = conclusions(spark, files, threshold_days=days)
    agreed = [found[str(i)].confidence == 100 for i in range(len(offsets))]
    assert agreed == [abs(o.days) <= days for o in offsets]


def test_new_source_needs_no_change(spark):
    rows = [(1, [(0, "diary", NOW, 99), (1, "filesystem_fallback", NOW, 30)])]
    frame = spark.createDataFrame(rows, f"file_id int, signals array<{schemas.SIGNAL}>")
    row = score_dates(frame, as_of=timestamp_literal(str(NOW))).first()
    assert (row.date_source, row.confidence, row.date_reason) == ("diary", 100, "diary -- confirmed by filesystem creation date")


def test_filter_on_conclusion_is_not_pushed_into_parsing(spark):
    rows = [(1, [(0, "exif_original", NOW, 95)])]
    frame = spark.createDataFrame(rows, f"file_id int, signals array<{schemas.SIGNAL}>")
    plan = score_dates(frame, as_of=timestamp_literal(str(NOW))).filter(F.col("confidence") < 50)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Filter") < text.index("Generate")
