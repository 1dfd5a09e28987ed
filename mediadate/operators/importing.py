"""From the inventory to the archive: eligibility, exclusion, plan, outcome."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate import settings
from mediadate.functions import camera, paths
from mediadate.functions.sizes import format_size
from mediadate.operators.naming import unique_destination
from mediadate.operators.scoring import score_dates
from mediadate.operators.signals import gather_signals

CATALOG_COLUMNS = [
    "archive_path", "source_path", "file_extension", "file_size", "date_taken", "date_source",
    "filesystem_creation_date", "date_uncertain", "date_added", "camera_make", "camera_model",
    "gps_latitude", "gps_longitude", "aperture", "iso_speed", "focal_length_mm", "confidence", "date_reason",
]


def eligible_files(inventory: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """Inventory rows an import run looks at: not yet imported, wanted extension."""
    open_status = F.col("status").isin("located", "excluded")
    return inventory.filter(open_status & F.lower("file_extension").isin(settings.dotted(extensions)))


def exclude_reason(
    path: Column, file_size: Column, has_exif: Column, filters: settings.ImportFilters
) -> Column:
    """The first rule a file fails, in words; null when it passes."""
    failed = F.when(F.lit(False), "")
    if filters.min_file_size:
        limit = F.lit(filters.min_file_size)
        text = F.concat(F.lit("below min size ("), format_size(file_size), F.lit(" < "), format_size(limit), F.lit(")"))
        failed = failed.when(file_size < limit, text)
    if filters.max_file_size:
        limit = F.lit(filters.max_file_size)
        text = F.concat(F.lit("above max size ("), format_size(file_size), F.lit(" > "), format_size(limit), F.lit(")"))
        failed = failed.when(file_size > limit, text)
    for term in filters.exclude_path_contains:
        failed = failed.when(path.contains(term), f"path contains excluded term '{term}'")
    if filters.exclude_thumbnails:
        suffix = paths.extension(path)
        text = F.concat(F.lit("thumbnail file ("), suffix, F.lit(")"))
        failed = failed.when(suffix.isin(settings.dotted(filters.thumbnail_extensions)), text)
    if filters.require_exif:
        failed = failed.when(~F.coalesce(has_exif, F.lit(False)), "no EXIF data found")
    return failed


def archive_folder(
    date_taken: Column, date_uncertain: Column, archive_root: str, review_folder: str, as_of: Column
) -> Column:
    """Day folder of a confident date, the review folder of an uncertain one."""
    day = paths.dated_folder(F.coalesce(date_taken, as_of))
    return paths.under_root(archive_root, F.when(date_uncertain == 1, review_folder).otherwise(day))


DATE_TEXTS = (
    "date_time_original", "date_time_digitized", "gps_date_stamp", "tiff_datetime", "xmp_create_date", "photoshop_date_created", "xmp_modify_date",
)


def import_outcomes(
    eligible: DataFrame,
    present: DataFrame,
    evidence: DataFrame,
    run: settings.ImportSettings,
    *,
    as_of: Column,
) -> DataFrame:
    """One row per eligible file: ``missing``, ``excluded`` with its reason, or ``planned``.

    ``present`` lists the source files that exist now (path, size, creation date); ``evidence`` holds
    their tags by path. A planned row carries the date conclusion, the camera columns and the target
    folder; it has no final name yet, see :func:`plan_destinations`.
    """
    now = present.select(
        F.col("path").alias("file_path"), F.col("file_size").alias("_size"), F.col("creation_date").alias("_created"),
        F.lit(True).alias("_present"),
    )
    tags = evidence.drop("file_size", "creation_date", "file_id").withColumnRenamed("path", "file_path")
    files = eligible.select("id", "file_path").join(now, "file_path", "left").join(tags, "file_path", "left")
    files = files.withColumns({"path": F.col("file_path"), "file_size": F.col("_size"), "creation_date": F.col("_created")})
    reason = exclude_reason(F.col("path"), F.col("file_size"), F.col("has_exif"), run.filters)
    files = files.withColumn("exclude_reason", F.when(F.col("_present"), reason))
    files = files.withColumn(
        "outcome",
        F.when(F.col("_present").isNull(), "missing").when(F.col("exclude_reason").isNotNull(), "excluded").otherwise("planned"),
    )
    if "file_type" not in files.columns:
        files = files.withColumn("file_type", F.lit(None).cast("string"))
    planned = F.col("outcome") == "planned"
    # Missing and excluded files get no conclusion, so their texts are not parsed.
    files = files.withColumns({c: F.when(planned, F.col(c)) for c in DATE_TEXTS if c in files.columns})
    scored = score_dates(gather_signals(files, try_ocr=run.try_ocr), as_of=as_of, threshold_days=run.threshold_days)
    folder = archive_folder(F.col("date_taken"), F.col("date_uncertain"), run.archive_root, run.review_folder, as_of)
    columns = {
        "folder": folder,
        "gps_latitude": camera.decimal_degrees(F.col("gps_lat"), F.col("gps_lat_ref")),
        "gps_longitude": camera.decimal_degrees(F.col("gps_lon"), F.col("gps_lon_ref")),
        "camera_make": camera.clean_text(F.col("make")),
        "camera_model": camera.clean_text(F.col("model")),
    }
    scored = scored.withColumns(columns).withColumn("name", paths.file_name(F.col("path")))
    conclusion = [
        "date_taken", "date_source", "filesystem_creation_date", "date_uncertain", "confidence", "date_reason",
        *columns, "aperture", "iso_speed", "focal_length_mm", "name",
    ]
    return scored.select(
        "id", F.col("path").alias("source_path"), paths.extension(F.col("path")).alias("file_extension"), "file_size",
        "outcome", "exclude_reason", *[F.when(planned, F.col(c)).alias(c) for c in conclusion],
    )


def plan_destinations(outcomes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Planned rows with their collision-free ``archive_path``; ``existing`` lists taken paths."""
    taken = None
    if existing is not None:
        path = F.col("archive_path")
        taken = existing.select(paths.parent_folder(path).alias("folder"), paths.file_name(path).alias("name"))
    planned = unique_destination(outcomes.filter("outcome = 'planned'"), taken)
    return planned.withColumn("archive_path", F.concat_ws("/", "folder", "dest_name")).drop("folder", "name", "dest_name")


def import_records(copied: DataFrame, catalog_paths: DataFrame, *, added_at: Column) -> DataFrame:
    """Catalog rows of copied files; a path the catalog already holds is left alone."""
    rows = copied.withColumn("date_added", added_at).select("id", *CATALOG_COLUMNS)
    return rows.join(catalog_paths.select("archive_path"), "archive_path", "left_anti").select("id", *CATALOG_COLUMNS)


def update_status(inventory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Inventory with the status a run gives its files; missing and failed files keep theirs."""
    new = outcomes.select(
        "id", F.when(F.col("outcome") == "copied", "imported").when(F.col("outcome") == "excluded", "excluded").alias("_status")
    )
    joined = inventory.join(new.filter("_status is not null"), "id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status").select(*inventory.columns)


def import_summary(outcomes: DataFrame) -> DataFrame:
    """One row of run counters."""
    outcome = F.col("outcome")
    copied = outcome == "copied"
    return outcomes.agg(
        F.count_if(copied).alias("copied"),
        F.count_if(copied & (F.col("date_uncertain") == 1)).alias("review"),
        F.count_if(outcome == "excluded").alias("excluded"),
        F.count_if(outcome == "failed").alias("failed"),
        F.count_if(outcome == "missing").alias("missing"),
        F.count(F.lit(1)).alias("total"),
    )
