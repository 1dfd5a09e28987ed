"""A whole import run: from the inventory to copied files and two new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate import settings
from mediadate.operators import importing, inventory
from mediadate.operators.lineage import settle_table
from mediadate.sources import contents
from mediadate.sources.snapshots import SnapshotTable


def run_import(
    located: SnapshotTable,
    archived: SnapshotTable,
    present: DataFrame,
    evidence: DataFrame,
    run: settings.ImportSettings,
    work_folder: str,
    *,
    as_of: Column,
    added_at: Column,
    on_disk: DataFrame,
) -> DataFrame:
    """Copy every file that passes, write the new catalog and inventory, return the run's counters.

    The plan and the outcome of each copy are written below ``work_folder`` first, so both
    snapshots come from one and the same outcome. ``on_disk`` lists what the archive folder holds
    (``path``), so that names of files the catalog does not know stay taken, too. The catalog is
    written before the inventory; a run that ended between them is made good by the next one, which
    takes files that the catalog names as a source for imported.
    """
    spark = evidence.sparkSession
    files, catalog = located.read(), archived.read()
    archived_before = catalog.select(F.col("source_path").alias("file_path")).distinct().withColumn("_held", F.lit(True))
    status = F.when(F.col("_held") & (F.col("status") == "located"), "imported").otherwise(F.col("status"))
    files = files.join(archived_before, "file_path", "left").withColumn("status", status).select(*files.columns)
    eligible = importing.eligible_files(files, run.extensions)
    outcomes = settle_table(importing.import_outcomes(eligible, present, evidence, run, as_of=as_of))
    taken = catalog.select("archive_path").union(on_disk.select(F.col("path").alias("archive_path")))

    plan_folder, result_folder = f"{work_folder}/plan", f"{work_folder}/copied"
    importing.plan_destinations(outcomes, taken).write.mode("overwrite").parquet(plan_folder)
    plan = spark.read.parquet(plan_folder)
    contents.copy_files(plan).write.mode("overwrite").parquet(result_folder)
    results = spark.read.parquet(result_folder).select("archive_path", F.col("outcome").alias("_copied"))

    done = plan.join(results, "archive_path").withColumn("outcome", F.col("_copied")).drop("_copied")
    records = importing.import_records(done.filter("outcome = 'copied'"), catalog, added_at=added_at)
    numbered = inventory.assign_ids(records.drop("id"), catalog, "archive_path")
    archived.write(catalog.unionByName(numbered, allowMissingColumns=True))

    columns = ["id", "outcome", "date_uncertain"]
    final = outcomes.filter("outcome <> 'planned'").select(*columns).unionByName(done.select(*columns))
    located.write(importing.update_status(files, final))
    return importing.import_summary(final)
