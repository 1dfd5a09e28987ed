"""Joins of rows with a hot key to a table that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 4096
HOT_ROWS = 20_000
HOT_SALTS = 256
BROADCAST_ROWS = 100_000


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``lookup`` on ``key`` with the rows of one key spread over many tasks.

    Rows get a salt from the ``spread`` column. Only the pairs of key and salt that occur, at most
    4096 per key and deduplicated map-side, meet the lookup; the rows then join their pair. With
    ``left_anti`` the rows whose key the lookup lacks are kept.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    pairs = salted.select(key, "_salt").distinct().join(lookup, key, how)
    return salted.join(pairs, [key, "_salt"]).drop("_salt")


def counted_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` to a written ``lookup`` that tells with ``count`` how many rows each key has.

    Only keys of more than ``hot_rows`` rows are salted, so even tables are shuffled once a side.
    There are at most (rows / hot_rows) hot keys; up to 100,000 of them are broadcast.
    """
    hot = lookup.filter(F.col("count") > hot_rows).select(key, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, key, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("count") > hot_rows, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    pairs = lookup.withColumn("_salt", F.explode(every))
    return marked.withColumn("_salt", salt).join(pairs, [key, "_salt"]).drop("_salt", "_hot")
