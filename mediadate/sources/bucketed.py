"""Catalog and listing as tables bucketed and sorted by path, so that joins by path need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Write rows as a bucketed table of the session's catalog, replacing it; the table.

    Rows are dealt out by the buckets' own hash first, so each bucket is one file. Tables with one
    number of buckets are joined by their keys file by file: a listing bucketed by ``path`` and a catalog
    bucketed by ``archive_path`` meet without an exchange, in every operator that joins them by path.
    Choose the number so that a bucket of the larger table fits a task (some hundred MB).
    """
    dealt = rows.repartition(buckets, F.col(key))
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return rows.sparkSession.table(table)
