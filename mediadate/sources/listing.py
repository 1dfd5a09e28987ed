"""Listings of folder trees as manifest tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediadate import schemas
from mediadate.functions import paths
from mediadate.operators.lineage import settle_table


def file_system(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def scan_binary_files(spark: SparkSession, *roots: str, zone: str = "UTC") -> DataFrame:
    """Manifest of the files below the roots, through any Hadoop file system.

    Bytes are not read. Spark skips empty files and names that start with ``_`` or ``.`` (the review
    folder, for one): :func:`walk_folders` lists completely and is what an audit needs. There is no
    creation date here; the modification date, on the clock of ``zone``, stands in for it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    changed = F.convert_timezone(F.current_timezone(), F.lit(zone), F.col("modificationTime").cast("timestamp_ntz"))
    return files.select(
        paths.local_path(F.col("path")).alias("path"), F.col("length").alias("file_size"),
        changed.alias("creation_date"), changed.alias("modification_date"),
    )


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["path"]:
            system, path = file_system(folder)
            prefix = folder[: len(folder) - len(path)]
            local = system.type_name == "local"
            rows = []
            for info in system.get_file_info(fs.FileSelector(path)):
                # Folders behind links are not entered; linked files count as files.
                if info.type == fs.FileType.Directory and not (local and os.path.islink(info.path)):
                    rows.append((prefix + info.path, True))
                elif info.type == fs.FileType.File:
                    rows.append((prefix + info.path, False))
            yield pd.DataFrame(rows, columns=["path", "is_folder"]).astype({"is_folder": bool})


def walk_folders(spark: SparkSession, *roots: str, zone: str = "UTC") -> DataFrame:
    """Manifest of every file below folders, hidden names and empty files included.

    Roots are paths on a shared mount or URIs of any store that pyarrow reads. Folders are listed
    level by level, each level as one distributed job; stats are then read by all tasks, on the
    clock of ``zone``. On a mount the change time is the creation date, elsewhere the modification
    date. A file whose stats cannot be read is left out.
    """
    for root in roots:
        system, path = file_system(root)
        if system.get_file_info(path).type != fs.FileType.Directory:
            raise NotADirectoryError(root)

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clock = ZoneInfo(zone)
        moment = lambda t: datetime.fromtimestamp(t, clock).replace(tzinfo=None)
        for batch in batches:
            rows = []
            for place in batch["path"]:
                try:
                    system, path = file_system(place)
                    if system.type_name == "local":
                        stat = os.stat(path)
                        rows.append((place, stat.st_size, moment(stat.st_ctime), moment(stat.st_mtime)))
                    else:
                        info = system.get_file_info(path)
                        changed = moment(info.mtime_ns / 1e9) if info.mtime_ns else None
                        rows.append((place, info.size, changed, changed))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "file_size", "creation_date", "modification_date"])

    level = spark.createDataFrame([(root.rstrip("/"),) for root in roots], "path string")
    files = None
    while True:
        listed = settle_table(level.repartition("path").mapInPandas(_entries, "path string, is_folder boolean"))
        found = listed.filter("not is_folder").select("path")
        files = found if files is None else files.unionByName(found)
        level = listed.filter("is_folder").select("path")
        if level.isEmpty():
            return files.repartition("path").mapInPandas(stats, schemas.MANIFEST)
