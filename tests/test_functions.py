"""Scalar rules: stamps, sizes, paths, camera fields."""

import random
import re
from datetime import datetime
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from mediadate.functions import camera, paths, sizes
from mediadate.operators import ocr_text
from mediadate.operators.scoring import timestamp_literal

STAMPS = [
    ("07.20.2010", 90.0, datetime(2010, 7, 20), True),
    ("07/15/99", 90.0, datetime(1999, 7, 15), True),
    ("05/06/07", 90.0, datetime(2005, 6, 7), True),
    ("15/07/1999", 90.0, datetime(1999, 7, 15), True),
    ("1024-07-15", 90.0, None, False),
    ("10:02", 90.0, None, False),
    ("07.20.2010", 40.0, datetime(2010, 7, 20), True),
    ("07.20.2010", 39.9, datetime(2010, 7, 20), False),
    ("24 11 26", 65.0, datetime(2024, 11, 26), True),
    ("24 11 26", 64.9, datetime(2024, 11, 26), False),
    ("'99 07 15", 45.0, datetime(1999, 7, 15), True),
    ("2030-01-01", 90.0, None, False),
    ("", 90.0, None, False),
]


def test_stamps(spark):
    frame = spark.createDataFrame([(i, i, t, c) for i, (t, c, _, _) in enumerate(STAMPS)], "file_id long, attempt_seq long, raw_text string, ocr_confidence double")
    rows = ocr_text.read_stamps(frame, timestamp_literal("2025-01-01 00:00:00")).orderBy("file_id").collect()
    assert [(r.stamp_date, r.accepted) for r in rows] == [(d, a) for _, _, d, a in STAMPS]


def test_first_accepted_attempt(spark):
    attempts = [(1, 1, "nothing", 99.0), (1, 2, "07.20.2010", 30.0), (1, 3, "07.21.2010", 55.25), (1, 4, "07.22.2010", 99.0), (2, 1, "x", 9.0)]
    frame = spark.createDataFrame(attempts, "file_id long, attempt_seq long, raw_text string, ocr_confidence double")
    now = timestamp_literal("2025-01-01 00:00:00")
    first, second = ocr_text.first_accepted(frame, now).orderBy("file_id").collect()
    assert (first.attempt_seq, first.ocr_date, first.ocr_confidence, first.checked) == (3, datetime(2010, 7, 21), 55.2, 3)
    assert (second.attempt_seq, second.ocr_date, second.checked) == (None, None, 1)
    assert ocr_text.checked_attempts(frame, now).count() == 4


def test_words_to_text(spark):
    words = [(1, 1, 2, "07", 80.0), (1, 1, 1, " ", 10.0), (1, 1, 3, "15", -1.0), (1, 2, 1, "", 50.0)]
    frame = spark.createDataFrame(words, "file_id long, attempt_seq long, word_seq long, text string, conf double")
    rows = ocr_text.attempt_texts(frame).orderBy("attempt_seq").collect()
    assert [(r.raw_text, r.ocr_confidence) for r in rows] == [("07 15", 80.0), ("", 0.0)]


def test_attempt_order(spark):
    frame = spark.createDataFrame([("bottom_right", 0, "raw"), ("bottom_left", 90, "otsu"), ("top_left", 270, "otsu")], "c string, r int, v string")
    order = frame.select(ocr_text.attempt_order(F.col("c"), F.col("r"), F.col("v")).alias("x")).collect()
    assert [r.x for r in order] == [0, 11, 31]


@pytest.mark.parametrize("number, text", [(0, "0.0B"), (1023, "1023.0B"), (1280, "1.2KB"), (1024**2 * 3 // 4 * 5, "3.8MB"), (1024**5, "1.0PB"), (None, None)])
def test_format_size(spark, number, text):
    frame = spark.createDataFrame([(number,)], "n long")
    assert frame.select(sizes.format_size(F.col("n")).alias("x")).first().x == text


def test_name_parts_match_path_objects(spark):
    names = [".jpg", "a.tar.GZ", "file.", "..jpg", "plain", "a b (1).jpg", "x.y.", "a.jpg.thm", "...", "ü.JPG"]
    frame = spark.createDataFrame([("/d/" + n,) for n in names], "p string")
    name = paths.file_name(F.col("p"))
    rows = frame.select(name.alias("n"), paths.suffix(name).alias("x"), paths.stem(name).alias("s")).collect()
    assert [(r.n, r.x, r.s) for r in rows] == [(n, PurePosixPath(n).suffix, PurePosixPath(n).stem) for n in names]


def test_placed_folder(spark):
    cases = {"/a/2024/01/02/x.jpg": "2024/01/02", "/a/2024/01/02/k/x.jpg": "2024/01/02", "/a/_review_needed/x.jpg": None, "/b/2024/01/02/x.jpg": None}
    frame = spark.createDataFrame([(p,) for p in cases], "p string")
    assert [r.x for r in frame.select(paths.placed_folder(F.col("p"), "/a/").alias("x")).collect()] == list(cases.values())


def test_camera_rounding_and_degrees(spark):
    frame = spark.createDataFrame([(0.15, [10.0, 30.0, 36.0], "S"), (1.25, [1.0, 0.0, 0.0], ""), (None, [1.0, 2.0], "N")], "f double, d array<double>, r string")
    rows = frame.select(camera.one_decimal(F.col("f")).alias("f"), camera.decimal_degrees(F.col("d"), F.col("r")).alias("d")).collect()
    assert [r.f for r in rows] == [f"{0.15:.1f}", f"{1.25:.1f}", None]
    assert [r.d for r in rows] == [-(10.0 + 30.0 / 60 + 36.0 / 3600), None, None]


def read_one_by_one(text, now):
    """The stamp rules served by the standard library."""
    separator = r"[\s\-\./]"
    ymd = rf"'?(\d{{4}}|\d{{2}}){separator}(\d{{1,2}}){separator}(\d{{1,2}})\b"
    xy = rf"\b(\d{{1,2}}){separator}(\d{{1,2}}){separator}'?(\d{{4}}|\d{{2}})\b"
    for pattern, (y, m, d) in ((ymd, (0, 1, 2)), (xy, (2, 0, 1)), (xy, (2, 1, 0))):
        match = re.search(pattern, text)
        if match is None:
            continue
        parts = [int(g) for g in match.groups()]
        year = parts[y] if parts[y] >= 100 else parts[y] + (1900 if parts[y] > 30 else 2000)
        try:
            day = datetime(year, parts[m], parts[d])
        except ValueError:
            continue
        return day if 1900 <= year and day <= now else None
    return None


def test_stamps_match_standard_library(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0011223999  ./-':") for _ in range(rng.randint(4, 14))) for _ in range(4000)]
    now = datetime(2025, 1, 1)
    frame = spark.createDataFrame([(i, i, t, 99.0) for i, t in enumerate(texts)], "file_id long, attempt_seq long, raw_text string, ocr_confidence double")
    rows = ocr_text.read_stamps(frame, timestamp_literal(str(now))).orderBy("file_id").collect()
    wrong = [(t, r.stamp_date) for t, r in zip(texts, rows) if r.stamp_date != read_one_by_one(t, now)]
    assert wrong[:5] == [] and sum(r.stamp_date is not None for r in rows) > 50
