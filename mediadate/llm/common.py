"""Shared pieces: intermediate tables, lookups of checked size, word patterns."""

from __future__ import annotations

import functools
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 100_000
SALTS = 256


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process.

    Functions travel to the workers by value, and so do the globals that they use; what a worker
    has built once is kept here for its later tasks.
    """
    return sys.__dict__.setdefault("_mediadate_worker_cache", {})


def remembered(function):
    """Keep the results of a function of hashable arguments in the worker."""

    @functools.wraps(function)
    def wrapper(*key):
        kept = worker_cache().setdefault(function.__qualname__, {})
        if key not in kept:
            kept[key] = function(*key)
        return kept[key]

    return wrapper


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " "), "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def file_system(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return fs.FileSystem.from_uri(place) if ":/" in place else (fs.LocalFileSystem(), place)


def settle(frame: DataFrame, **options) -> DataFrame:
    """Write a frame as Parquet, with these options, to the shared folder and go on from the written copy.

    The copy outlives executors; its folder is the ``settled`` attribute of the result.
    """
    spark = frame.sparkSession
    place = shared_folder(spark)
    frame.write.options(compression="zstd", **options).parquet(place)
    copy = spark.read.schema(frame.schema).parquet(place)
    copy.settled = place
    return copy


def discard(*frames: DataFrame) -> None:
    """Delete the files of settled frames that no later step reads."""
    for frame in frames:
        system, path = file_system(frame.settled)
        system.delete_dir(path)


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "inner", at_most: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows to a table that has each key once, whatever share of the rows one key holds.

    A lookup of at most 100,000 rows (``at_most``: 0 for wide ones) is broadcast. A larger one meets the occurring pairs of key
    and salt, at most 256 a key and deduplicated before the shuffle; rows then meet their pair.
    """
    if lookup.count() <= at_most:
        return rows.join(F.broadcast(lookup), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    pairs = salted.select(*keys, "_salt").distinct().join(lookup, keys, how)
    return salted.join(pairs, [*keys, "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_parts(batch: pa.RecordBatch, most: int):
    """Rows of the batch with some ``most`` bytes of ``text`` at a time, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
