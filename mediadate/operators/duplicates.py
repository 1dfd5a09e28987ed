"""Groups of files with identical bytes and the space they waste."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.operators.lineage import settle_table
from mediadate.operators.skew import counted_join


def known_hash(column: Column) -> Column:
    """A stored hash, null when there is none."""
    return F.nullif(column, F.lit(""))


def missing_hashes(records: DataFrame, present: DataFrame, key: str = "file_path") -> DataFrame:
    """``path`` of the recorded files that are there and have no stored hash; only these are read."""
    waiting = records.filter(known_hash(F.col("file_hash")).isNull()).select(F.col(key).alias("path"))
    return present.select("path").join(waiting, "path", "left_semi")


def unhashed_files(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """``path`` of the files on disk for which the catalog holds no hash, unknown files included."""
    held = catalog.filter(known_hash(F.col("file_hash")).isNotNull()).select(F.col("archive_path").alias("path"))
    return listing.select("path").join(held, "path", "left_anti")


def fill_hashes(records: DataFrame, hashes: DataFrame, key: str = "file_path") -> DataFrame:
    """Records with the missing hashes filled from ``hashes (key, new_hash)``; stored ones stay."""
    joined = records.join(hashes.select(key, "new_hash"), key, "left")
    filled = F.coalesce(known_hash(F.col("file_hash")), F.col("new_hash"), F.col("file_hash"))
    return joined.withColumn("file_hash", filled).drop("new_hash").select(*records.columns)


def source_entries(inventory: DataFrame, hashes: DataFrame, statuses: Iterable[str] = ("located",)) -> DataFrame:
    """Inventory files of the given statuses that have a hash, stored or newly computed.

    A file that vanished after it was hashed still counts by its stored hash.
    """
    checked = inventory.filter(F.col("status").isin(*statuses)).select("id", "file_path", "file_size", "file_hash")
    checked = fill_hashes(checked, hashes)
    return checked.filter(known_hash(F.col("file_hash")).isNotNull()).select(
        F.col("id").alias("position"), F.col("file_path").alias("path"), "file_size", "file_hash",
        F.lit(True).alias("documented"),
    )


def archive_entries(listing: DataFrame, catalog: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files on disk with their hash, cached or newly computed, and whether the catalog knows them.

    The size is the catalog's for a documented file (the listing's when it is empty or zero on a
    file without a cached hash) and the listing's for an undocumented one.
    """
    records = catalog.select(
        F.col("archive_path").alias("path"), F.col("file_size").alias("_size"),
        known_hash(F.col("file_hash")).alias("cached"), F.lit(True).alias("_known"),
    )
    joined = listing.select("path", "file_size").join(records, "path", "left").join(hashes, "path", "left")
    documented = F.col("_known").isNotNull()
    size = (
        F.when(F.col("cached").isNotNull(), F.col("_size"))
        .when(documented & (F.col("_size") != 0), F.col("_size"))
        .otherwise(F.col("file_size"))
    )
    origin = F.when(F.col("cached").isNotNull(), "cached").when(documented, "newly_hashed").otherwise("undocumented")
    entries = joined.select(
        F.col("path").alias("position"), "path", size.alias("file_size"),
        F.coalesce("cached", "new_hash").alias("file_hash"), documented.alias("documented"), origin.alias("origin"),
    )
    return entries.filter("file_hash is not null")


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """Hashes that occur more than once, with count, size of the first entry and wasted bytes.

    Counts are pre-aggregated map-side, so a hash shared by a third of all files costs no more than
    any other.
    """
    groups = entries.groupBy("file_hash").agg(
        F.min_by("file_size", "position").alias("file_size"),
        F.count(F.lit(1)).alias("count"),
        F.min_by("path", "position").alias("first_path"),
    )
    wasted = F.coalesce(F.col("file_size"), F.lit(0)) * (F.col("count") - 1)
    return groups.filter("count > 1").withColumn("wasted_bytes", wasted)


def report_order(groups: DataFrame) -> DataFrame:
    """Most wasteful group first."""
    return groups.orderBy(F.desc("wasted_bytes"), "first_path")


def duplicate_members(entries: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The files of every duplicate group, one row each, a hot hash spread over many tasks.

    The entries are computed once and written, as both groups and members are read from them.
    """
    entries = settle_table(entries.select("position", "file_hash", "path", "file_size", "documented"))
    groups = settle_table((duplicate_groups(entries) if groups is None else groups).select("file_hash", "count"))
    members = entries.select("file_hash", "path", "file_size", "documented")
    return counted_join(members, groups, "file_hash", "path")


def duplicate_summary(entries: DataFrame) -> DataFrame:
    """One row: files checked, groups, files in groups, wasted bytes."""
    per_hash = entries.groupBy("file_hash").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min_by("file_size", "position"), F.lit(0)).alias("size")
    )
    group = F.col("n") > 1
    return per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files_checked"),
        F.count_if(group).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(group, F.col("n"))), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(group, F.col("size") * (F.col("n") - 1))), F.lit(0)).alias("wasted_bytes"),
    )


def archive_cache_counters(entries: DataFrame) -> DataFrame:
    """How the hashes of an archive run came about."""
    origin = F.col("origin")
    return entries.agg(
        F.count_if(origin == "cached").alias("documented_cached"),
        F.count_if(origin == "newly_hashed").alias("documented_newly_hashed"),
        F.count_if(origin == "undocumented").alias("undocumented_hashed"),
    )


def source_cache_counters(
    inventory: DataFrame, present: DataFrame, hashes: DataFrame, statuses: Iterable[str] = ("located",)
) -> DataFrame:
    """How the hashes of an inventory run came about; a vanished file counts as missing only."""
    checked = inventory.filter(F.col("status").isin(*statuses)).select("file_path", "file_hash")
    now = present.select(F.col("path").alias("file_path"), F.lit(True).alias("_present"))
    joined = checked.join(now, "file_path", "left").join(hashes, "file_path", "left")
    there, cached = F.col("_present").isNotNull(), known_hash(F.col("file_hash")).isNotNull()
    return joined.agg(
        F.count_if(there & cached).alias("already_hashed"),
        F.count_if(there & ~cached & F.col("new_hash").isNotNull()).alias("newly_hashed"),
        F.count_if(~there).alias("missing"),
    )
