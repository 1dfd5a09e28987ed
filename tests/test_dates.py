"""Date texts against the standard library, over generated inputs."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mediadate.functions import dates


def parsed(spark, texts, expression):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", expression(F.col("t")).alias("d")).orderBy("i").collect()
    return [row.d for row in rows]


def strict(text):
    try:
        return datetime.strptime(text, "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None


def iso(text):
    text = text.strip()
    if text[-1:] == "Z":
        text = text[:-1] + "+00:00"
    for parse in (datetime.fromisoformat, lambda t: datetime.strptime(t, "%Y-%m-%d")):
        try:
            return parse(text).replace(tzinfo=None)
        except ValueError:
            continue
    return None


def test_camera_date_matches_strptime(spark):
    rng = random.Random(1)
    texts = [
        "2024:1:5 1:2:3", "2024:01:02  03:04:05", "2024:02:30 00:00:00", "2024:02:29 23:59:59", "2023:02:29 00:00:00",
        "2024:01:02 03:04:60", "2024:01:02 03:04:05 ", "2024:01:02 03:04", " 2024:01:02 03:04:05", "0000:01:02 03:04:05",
        "0001:01:01 00:00:00", "9999:12:31 23:59:59", "2024: 1: 5 01:02:03", "2024:01: 5 01:02:03", "2024-01-02 03:04:05", "",
        "2024:01:02\t03:04:05", "2024:01:02 03:04:05\n", "2024:13:02 03:04:05", "2024:01:02 24:00:00", "2024:00:10 00:00:00",
    ]
    for _ in range(3000):
        fields = [rng.choice([1, 12, 1960, 2024, 9999]), rng.randint(0, 13), rng.randint(0, 32),
                  rng.randint(0, 25), rng.randint(0, 61), rng.randint(0, 62)]
        widths = [4] + [rng.choice([1, 2, 2, 2]) for _ in range(5)]
        y, mo, d, h, mi, s = (str(f).zfill(w) for f, w in zip(fields, widths))
        texts.append(f"{y}:{mo}:{d}{rng.choice([' ', '  ', 'T', ''])}{h}:{mi}:{s}{rng.choice(['', '', '', ' ', 'Z'])}")
    assert parsed(spark, texts, dates.camera_date) == [strict(t) for t in texts]


def test_xmp_date_matches_fromisoformat(spark):
    rng = random.Random(2)
    texts = [
        "2024-01-02T03:04:05+09:00", "2024-01-02T03:04:05Z", "2024-03-05", "20240102", "2024", "2024-03", "2024-1-5",
        " 2024-01-02 ", "2024-W01-2", "2024W012", "2020-W53-7", "2021-W53-1", "2024-W01", "2024-W00-1", "2024-W01-8",
        "2024-01-02T", "2024-01-02T03", "2024-01-02T0304", "2024-01-02T030405.5", "2024-01-02T03:04:05,123456789",
        "2024-01-02T03:0405", "2024-01-02T03:04:60", "2024-01-02T24:00:00", "2024-01-02+00:00", "2024-01-02T03:04:05+24:00",
        "2024-01-02T03:04:05+23:59", "2024-01-02T03:04:05-0930", "2024-01-02T03:04:05+09:00:30.5", "202401021 03", "2024-0102",
        "0000-01-01", "2024-01-02T03:04:05+00:99", "2024-02-30T00:00:00", "2024-01-02T03:04+", "2024-01-02TZ", "2024-01-02Z",
    ]
    for _ in range(4000):
        dash, colon = rng.choice(["-", "-", ""]), rng.choice([":", ":", ""])
        year = str(rng.choice([1, 1960, 2024, 2020, 9998])).zfill(4)
        if rng.random() < 0.2:
            text = f"{year}{dash}W{rng.randint(0, 54):02d}" + rng.choice(["", f"{dash}{rng.randint(0, 8)}"])
        else:
            text = f"{year}{dash}{rng.randint(0, 13):02d}{dash}{rng.randint(0, 32):02d}"
        if rng.random() < 0.7:
            clock = [f"{rng.randint(0, 24):02d}", f"{rng.randint(0, 60):02d}", f"{rng.randint(0, 60):02d}"]
            text += rng.choice("T T_") + colon.join(clock[: rng.randint(1, 3)])
            if rng.random() < 0.3:
                text += rng.choice(".,") + str(rng.randint(0, 99999999))
            text += rng.choice(["", "", "Z", "+09:00", "-0330", "+09", "+9", "+23:59", "+24:00", "+01:02:03"])
        texts.append(text)
    wrong = [(t, d, iso(t)) for t, d in zip(texts, parsed(spark, texts, dates.xmp_date)) if d != iso(t)]
    assert wrong[:5] == []


@pytest.mark.parametrize(
    "date_stamp, time_stamp, expected",
    [
        ("2024:01:02", [3.0, 4.0, 5.9], datetime(2024, 1, 2, 3, 4, 5)),
        ("2024:01:02", None, datetime(2024, 1, 2)),
        ("2024:01:02", [], datetime(2024, 1, 2)),
        (" 2024 :+1:0_2", [0.0, 0.0, 0.0], datetime(2024, 1, 2)),
        ("2024:01", [3.0, 4.0, 5.0], None),
        ("2024:01:02:03", None, None),
        ("2024:01:02", [3.0, 4.0], None),
        ("2024:01:02", [3.0, 4.0, 60.0], None),
        ("2024:01:02", [-0.5, 4.0, 5.0], datetime(2024, 1, 2, 0, 4, 5)),
        ("2024:02:30", None, None),
        ("2024:x:02", None, None),
        ("", None, None),
        (None, [3.0, 4.0, 5.0], None),
    ],
)
def test_gps_date(spark, date_stamp, time_stamp, expected):
    frame = spark.createDataFrame([(date_stamp, time_stamp)], "d string, t array<double>")
    assert frame.select(dates.gps_date(F.col("d"), F.col("t")).alias("x")).first().x == expected


def test_sources_fall_through(spark):
    frame = spark.createDataFrame(
        [("bad", "2024:01:02 03:04:05"), ("2023:01:02 03:04:05", None), (None, None)], "a string, b string"
    )
    rows = frame.select(dates.exif_date(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x.source for r in rows] == ["exif_digitized", "exif_original", None]


def test_iso_text(spark):
    moments = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60), None]
    frame = spark.createDataFrame([(m,) for m in moments], "d timestamp_ntz")
    texts = [r.x for r in frame.select(dates.iso_text(F.col("d")).alias("x")).collect()]
    assert texts == [m.isoformat() if m else None for m in moments]
