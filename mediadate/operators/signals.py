"""Date signals a file's evidence gives rise to, in the order they are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate import schemas, settings
from mediadate.functions import dates, paths


def signal(seq: int, source, date: Column, base_confidence: dict[str, int]) -> Column:
    """One signal struct, null without a date; ``source`` is a name or a column of names."""
    if isinstance(source, str):
        name, base = F.lit(source), F.lit(base_confidence[source])
    else:
        name = source
        base = F.try_element_at(base_map(base_confidence), name)
    return F.when(
        date.isNotNull(),
        F.struct(F.lit(seq).alias("seq"), name.alias("source"), date.alias("date"), base.cast("int").alias("base_confidence")),
    )


def base_map(base_confidence: dict[str, int]) -> Column:
    """Lookup of the confidence of each source."""
    return F.create_map(*[F.lit(x) for pair in base_confidence.items() for x in pair])


def gather_signals(
    evidence: DataFrame,
    *,
    try_ocr: bool = False,
    base_confidence: dict[str, int] = settings.BASE_CONFIDENCE,
) -> DataFrame:
    """Add ``signals``: the dates that a file's type lets its evidence speak for.

    ``evidence`` holds the tag columns of :data:`mediadate.schemas.EVIDENCE_TAGS`, ``path``,
    ``file_type`` (overrides the suffix when set) and ``creation_date``. With ``try_ocr`` it also
    holds ``ocr_date``, the accepted stamp. One projection, no shuffle.
    """
    kind = F.coalesce(F.when(F.col("file_type") != "", F.col("file_type")), paths.extension(F.col("path")))
    typed = evidence.withColumn("_kind", kind)
    is_jpeg = F.col("_kind").isin(*settings.JPEG_TYPES)
    is_tiff = F.col("_kind").isin(*settings.TIFF_TYPES)

    # Every parsed text gets a column of its own: parsed once, in compiled code.
    def of_jpeg(parse, *tags):
        return F.when(is_jpeg, parse(*(F.col(tag) for tag in tags)))

    parsed = typed.withColumns(
        {
            "_gps": of_jpeg(dates.gps_date, "gps_date_stamp", "gps_time_stamp"),
            "_original": of_jpeg(dates.camera_date, "date_time_original"),
            "_digitized": of_jpeg(dates.camera_date, "date_time_digitized"),
            "_created": of_jpeg(dates.xmp_date, "xmp_create_date"),
            "_photoshop": of_jpeg(dates.xmp_date, "photoshop_date_created"),
            "_modified": of_jpeg(dates.xmp_date, "xmp_modify_date"),
            "_tiff": F.when(is_tiff, dates.camera_date(F.col("tiff_datetime"))),
        }
    )
    exif = dates.first_dated(("exif_original", F.col("_original")), ("exif_digitized", F.col("_digitized")))
    creation = F.coalesce("_created", "_photoshop")
    xmp = dates.first_dated(("xmp_create_date", creation), ("xmp_modify_date", F.col("_modified")))
    found = [
        signal(1, "exif_gps", F.col("_gps"), base_confidence),
        signal(2, exif["source"], exif["date"], base_confidence),
        signal(3, xmp["source"], xmp["date"], base_confidence),
        signal(4, "tiff_datetime", F.col("_tiff"), base_confidence),
    ]
    if try_ocr:
        stamp = F.when(is_jpeg | is_tiff, F.col("ocr_date"))
        found.append(signal(5, "ocr_corner_stamp", stamp, base_confidence))
    found.append(signal(6, "filesystem_fallback", F.col("creation_date"), base_confidence))
    gathered = parsed.withColumn("signals", F.array_compact(F.array(*found)).cast(f"array<{schemas.SIGNAL}>"))
    return gathered.select(*evidence.columns, "signals")


def explode_signals(with_signals: DataFrame, id_column: str = "file_id") -> DataFrame:
    """Long form: one row per signal."""
    # The outer form keeps Spark from testing the array's size below the parsing that builds it.
    return with_signals.select(id_column, F.inline_outer("signals")).filter("seq is not null")


def collect_signals(long_signals: DataFrame, id_column: str = "file_id") -> DataFrame:
    """Wide form: one row per file, signals in gather order.

    A file has at most one signal per source, so the array is bounded by the number of sources.
    """
    one = F.struct("seq", "source", "date", "base_confidence")
    return long_signals.groupBy(id_column).agg(F.array_sort(F.collect_list(one)).alias("signals"))
