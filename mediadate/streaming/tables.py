"""Streams that carry a table forward, a part per micro-batch.

A batch writes what it adds or changes and nothing else. A batch that is run again after a failure
finds its part finished and writes nothing, so nothing is appended or corrected twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mediadate.operators import inventory, review
from mediadate.sources.snapshots import AppendTable, ChangeTable, written_once

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key through and remembers the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda row: repr(row.asDict()))

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        self.seen.update((True,))


def stream_inventory(
    manifest: DataFrame, table: AppendTable, checkpoint: str, extensions: Iterable[str]
) -> StreamingQuery:
    """Append the unknown files of a streamed manifest to the inventory.

    Which paths are known is keyed state of the stream, in a RocksDB store on the executors and below
    ``checkpoint``. The inventory as it is at the stream's first start fills it; after that a batch
    reads its own rows and their keys' state only, however large the inventory has become. Batches are
    numbered on from the table's last one at that start. Of several rows of one path in a batch the least by its columns' text counts.
    """
    spark = manifest.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    scanned = inventory.scan_inventory(manifest, list(extensions))
    known = table.read().select("file_path").distinct()
    fresh = scanned.groupBy("file_path").transformWithState(
        FirstSeen(), scanned.schema, "Append", "None", known.groupBy("file_path")
    )

    start = f"{checkpoint.rstrip('/')}-start"
    first = written_once(spark, start, lambda: spark.createDataFrame([(max(table.batches(), default=-1) + 1,)], "first long")).first()[0]

    def append(batch: DataFrame, batch_id: int) -> None:
        if first + batch_id not in table.batches():
            table.write(inventory.assign_ids(batch, None, top=table.highest("id")), first + batch_id)
        else:
            batch.write.format("noop").mode("overwrite").save()  # the rows are there, the state is not

    writer = fresh.writeStream.foreachBatch(append)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_corrections(
    corrections: DataFrame,
    table: ChangeTable,
    checkpoint: str,
    results_folder: str,
    *,
    archive_root: str,
    corrected_at: Column,
    listing: Callable[[], DataFrame] | None = None,
    move: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Apply streamed corrections to the catalog and write one result row for each.

    ``listing`` gives the files on disk; without it every catalog file counts as present. ``move``
    carries out a plan and returns ``new_archive_path, outcome, error``
    (:func:`mediadate.sources.contents.move_files`); only what was moved changes the catalog. The
    corrections of a batch end as if they had come one by one. Guard, plans and outcomes are written,
    round by round, below ``<results_folder>_steps``. A batch that is run again after some of its
    moves finds them there and comes to the same end.
    """

    def correct(batch: DataFrame, batch_id: int) -> None:
        if table.last_batch() >= batch_id:
            return
        catalog = table.read(before=batch_id)
        spark = catalog.sparkSession

        def once(name: str, build: Callable[[], DataFrame]) -> DataFrame:
            return written_once(spark, f"{results_folder.rstrip('/')}_steps/batch={batch_id}/{name}", build)

        catalog_paths = catalog.select("archive_path")
        disk = catalog_paths.withColumnRenamed("archive_path", "path") if listing is None else listing().select("path")
        guarded = once("guarded", lambda: review.guard_corrections(batch, catalog, disk))
        taken = catalog_paths.union(disk).distinct()
        served = review.serve_corrections(guarded, taken, archive_root, move, once)
        results = review.correction_results(guarded, served)
        results.write.mode("overwrite").parquet(f"{results_folder}/batch={batch_id}")
        touched = catalog.join(served.filter("error is null").select(F.col("file_id").alias("id")), "id", "left_semi")
        table.write(review.apply_corrections(touched, served, corrected_at=corrected_at), batch_id)

    writer = corrections.writeStream.foreachBatch(correct)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
