"""The accumulative file inventory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediadate import settings
from mediadate.functions import paths
from mediadate.operators.lineage import settle_table

NEW_COLUMNS = ["file_path", "file_extension", "file_size", "creation_date", "modification_date"]


def scan_inventory(manifest: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """Files of a listing whose suffix is wanted, with their stat columns."""
    found = manifest.select(
        F.col("path").alias("file_path"),
        paths.extension(F.col("path")).alias("file_extension"),
        "file_size",
        "creation_date",
        "modification_date",
    )
    return found.filter(F.col("file_extension").isin(settings.dotted(extensions)))


def archive_listing(manifest: DataFrame, extensions: Iterable[str] = ()) -> DataFrame:
    """Files of an archive root without its catalog file; no extensions means all."""
    wanted = settings.dotted(extensions)
    name = paths.file_name(F.col("path"))
    listing = manifest.filter(name != settings.CATALOG_FILE_NAME)
    return listing.filter(paths.extension(F.col("path")).isin(wanted)) if wanted else listing


def append_new(inventory: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of a scan that the inventory does not hold yet, one per path, marked ``located``.

    A path already known keeps its row as it was first seen. Of several rows of one path in the same
    scan the one with the earliest stat values is taken.
    """
    rest = [c for c in NEW_COLUMNS if c != "file_path"]
    firsts = scanned.groupBy("file_path").agg(F.min(F.struct(*rest)).alias("_row")).select("file_path", "_row.*")
    fresh = firsts.join(inventory.select("file_path"), "file_path", "left_anti")
    return fresh.select(*NEW_COLUMNS, F.lit("located").alias("status"))


def append_counts(inventory: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: files found, inserted and skipped."""
    per_path = scanned.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    known = inventory.select("file_path", F.lit(True).alias("known"))
    counted = per_path.join(known, "file_path", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("found"), F.count_if(F.col("known").isNull()).alias("inserted")
    )
    return counted.withColumn("skipped", F.col("found") - F.col("inserted"))


def assign_ids(fresh: DataFrame, inventory: DataFrame | None, key: str = "file_path", top: int | None = None) -> DataFrame:
    """Give new rows dense ids in key order, following the highest id in use (``top``, if it is known).

    Keys are sorted by range over the cluster. One row per range, as many as there are shuffle
    partitions, is summed in one place and sent back to all.
    """
    ordered = fresh.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered = settle_table(ordered.withColumn("_local", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_local", 33))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    if top is None:
        top = inventory.agg(F.max("id")).first()[0] or 0
    numbered = ordered.join(F.broadcast(starts), "_part")
    local = F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("id", F.col("_start") + local + F.lit(top + 1))
    return numbered.drop("_local", "_part", "_start")
