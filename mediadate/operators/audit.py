"""Reconcile a listing of the archive folder with the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.functions import dates, paths


def as_timestamp(column: Column, is_text: bool) -> Column:
    """A date column of either kind; a text that is no ISO date gives null."""
    return dates.iso_date(column) if is_text else column


def effective_date(catalog: DataFrame) -> Column:
    """A person's correction where there is one, else the date the analysis found."""
    kinds = dict(catalog.dtypes)

    def date(name):
        is_text = kinds[name] == "string"
        return is_text, F.nullif(F.col(name), F.lit("")) if is_text else F.col(name)

    corrected_text, corrected = date("user_corrected_date")
    taken_text, taken = date("date_taken")
    return F.when(corrected.isNotNull(), as_timestamp(corrected, corrected_text)).otherwise(
        as_timestamp(taken, taken_text)
    )


def classify(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every path of either side once, with its ``section``: matched, undocumented or missing."""
    disk = listing.select("path", F.lit(True).alias("on_disk"))
    records = catalog.select(F.col("archive_path").alias("path"), F.lit(True).alias("in_catalog"))
    section = (
        F.when(F.col("on_disk") & F.col("in_catalog"), "matched")
        .when(F.col("on_disk"), "undocumented")
        .otherwise("missing")
    )
    return disk.join(records, "path", "full_outer").select("path", section.alias("section"))


def missing_files(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows whose file is gone."""
    return catalog.join(listing.select(F.col("path").alias("archive_path")), "archive_path", "left_anti")


def misplaced_files(listing: DataFrame, catalog: DataFrame, archive_root: str) -> DataFrame:
    """Files on both sides that lie in another day folder than their date says."""
    path = F.col("archive_path")
    corrected = F.col("user_corrected_date").isNotNull()
    if dict(catalog.dtypes)["user_corrected_date"] == "string":
        corrected = corrected & (F.col("user_corrected_date") != "")
    judged = catalog.select(
        "archive_path",
        paths.placed_folder(path, archive_root).alias("actual_folder"),
        paths.dated_folder(effective_date(catalog)).alias("expected_folder"),
        effective_date(catalog).alias("date_taken"),
        F.when(corrected, "user_corrected").otherwise("original").alias("date_source"),
    ).filter("expected_folder <> actual_folder")
    # Cheap tests first: only rows in the wrong folder need to be looked up in the listing.
    found = judged.join(listing.select(F.col("path").alias("archive_path")), "archive_path", "left_semi")
    expected = F.concat_ws("/", "expected_folder", paths.file_name(path))
    return found.select(
        "archive_path", expected.alias("expected_relative_path"), "actual_folder", "expected_folder", "date_taken", "date_source"
    )


def undocumented_files(listing: DataFrame, catalog: DataFrame, evidence: DataFrame, archive_root: str) -> DataFrame:
    """Files without a catalog row, checked against their EXIF date, else their file date.

    ``evidence`` holds ``path, date_time_original, date_time_digitized``; GPS, XMP and TIFF dates
    take no part in this check.
    """
    records = catalog.select(F.col("archive_path").alias("path"))
    unknown = listing.join(records, "path", "left_anti")
    tags = evidence.select("path", "date_time_original", "date_time_digitized")
    unknown = unknown.join(tags, "path", "left")
    exif = dates.exif_date(F.col("date_time_original"), F.col("date_time_digitized"))["date"]
    unknown = unknown.withColumn("_exif", exif)
    source = F.when(F.col("_exif").isNotNull(), "exif").when(F.col("creation_date").isNotNull(), "filesystem_fallback")
    expected = paths.dated_folder(F.coalesce("_exif", "creation_date"))
    actual = paths.placed_folder(F.col("path"), archive_root)
    judged = unknown.withColumns({"_expected": expected, "_actual": actual})
    wrong = F.coalesce(F.col("_expected") != F.col("_actual"), F.lit(False))
    return judged.select(
        "path", "file_size", F.col("modification_date").alias("modified_date"), source.alias("date_source"),
        (~wrong).alias("correctly_placed"),
        F.when(wrong, F.col("_expected")).alias("expected_folder"),
        F.when(wrong, F.col("_actual")).alias("actual_folder"),
    )


def audit_summary(listing: DataFrame, catalog: DataFrame, evidence: DataFrame, archive_root: str) -> DataFrame:
    """One row of counts over one full outer join, and whether nothing is amiss."""
    disk = listing.select("path", "creation_date", F.lit(True).alias("on_disk"))
    records = catalog.select(
        F.col("archive_path").alias("path"), effective_date(catalog).alias("_date"), F.lit(True).alias("in_catalog")
    )
    tags = evidence.select("path", "date_time_original", "date_time_digitized")
    both = disk.join(tags, "path", "left").join(records, "path", "full_outer")
    on_disk, in_catalog = F.col("on_disk").isNotNull(), F.col("in_catalog").isNotNull()
    # The joins share one shuffle by path; only the tags of files without a record are parsed after them.
    exif = dates.exif_date(*(F.when(~in_catalog, F.col(c)) for c in ("date_time_original", "date_time_digitized")))["date"]
    expected = F.when(in_catalog, F.col("_date")).otherwise(F.coalesce(exif, F.col("creation_date")))
    wrong = F.coalesce(paths.dated_folder(expected) != paths.placed_folder(F.col("path"), archive_root), F.lit(False))
    counted = both.select(on_disk.alias("d"), in_catalog.alias("c"), wrong.alias("w")).agg(
        F.count_if("d").alias("on_disk"),
        F.count_if("c").alias("in_database"),
        F.count_if(F.col("d") & ~F.col("c")).alias("undocumented_count"),
        F.count_if(F.col("c") & ~F.col("d")).alias("missing_count"),
        F.count_if(F.col("d") & F.col("c") & F.col("w")).alias("misplaced_count"),
        F.count_if(F.col("d") & ~F.col("c") & F.col("w")).alias("undocumented_misplaced_count"),
    )
    amiss = ["undocumented_count", "missing_count", "misplaced_count", "undocumented_misplaced_count"]
    return counted.withColumn("in_sync", sum(F.col(c) for c in amiss) == 0)


def summary_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics of two one-row summaries that differ."""

    def long(frame, value):
        metrics = [F.col(c).cast("long").alias(c) for c in frame.columns]
        return frame.select(*metrics).unpivot([], frame.columns, "metric", value)

    changed = long(before, "before").join(long(after, "after"), "metric")
    return changed.filter("before <> after")
