"""The review queue and a person's date corrections."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediadate.functions import paths
from mediadate.operators.lineage import discard_tables, settle_table
from mediadate.operators.naming import family, unique_destination
from mediadate.operators.skew import spread_join

# Refusals of a correction.
UNKNOWN_ID = ("No file with id ", ".")
NOT_UNCERTAIN = ("File id ", " is not marked uncertain (date_uncertain=", ")")
NOT_ELIGIBLE = (
    " and has never been manually corrected. Corrections are only permitted for files "
    "still in the review bucket -- a file the algorithm was already confident about "
    "shouldn't be overridden this way. (A file you've already corrected once can still "
    "be corrected again, if you need to fix your own earlier correction.)"
)
FILE_GONE = "File no longer exists on disk: "


def with_location(rows: DataFrame, listing: DataFrame, base_path: str = "") -> DataFrame:
    """Add the absolute path of catalog rows and whether the file is there."""
    path = F.col("archive_path")
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base_path.rstrip("/") + "/"), path))
    found = listing.select(F.col("path").alias("archive_path"), F.lit(True).alias("_found"))
    located = rows.join(found, "archive_path", "left").withColumns(
        {"absolute_path": absolute, "file_exists": F.col("_found").isNotNull()}
    )
    return located.drop("_found")


def review_queue(catalog: DataFrame, listing: DataFrame, base_path: str = "") -> DataFrame:
    """Catalog rows with an uncertain date, newest first."""
    waiting = catalog.filter("date_uncertain = 1")
    return with_location(waiting, listing, base_path).orderBy(F.desc("date_added"), "id")


def review_top(catalog: DataFrame, listing: DataFrame, n: int, base_path: str = "") -> DataFrame:
    """The ``n`` newest rows of the review queue."""
    newest = catalog.filter("date_uncertain = 1").orderBy(F.desc("date_added"), "id").limit(n)
    return with_location(newest, listing, base_path).orderBy(F.desc("date_added"), "id")


def file_details(catalog: DataFrame, listing: DataFrame, file_id: int, base_path: str = "") -> DataFrame:
    """The catalog row of one id; no row when there is none."""
    return with_location(catalog.filter(F.col("id") == file_id), listing, base_path)


def guard_corrections(corrections: DataFrame, catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Corrections ``(seq, file_id, corrected_date)`` with the catalog row and ``error``.

    Refused are an unknown id, a file that was never uncertain, and a file that is gone, in this
    order. What is accepted here stays accepted whatever corrections come before it: a file that
    was corrected may be corrected again.
    """
    rows = catalog.select(
        F.col("id").alias("file_id"), "archive_path", "date_uncertain", "user_corrected_date", F.lit(True).alias("_known")
    )
    found = listing.select(F.col("path").alias("archive_path"), F.lit(True).alias("_found"))
    joined = corrections.join(rows, "file_id", "left").join(found, "archive_path", "left")
    label = F.col("file_id").cast("string")
    state = F.coalesce(F.col("date_uncertain").cast("string"), F.lit("None"))
    eligible = F.coalesce(F.col("date_uncertain") == 1, F.lit(False)) | F.col("user_corrected_date").isNotNull()
    unknown, (head, middle, tail) = [F.lit(text) for text in UNKNOWN_ID], [F.lit(text) for text in NOT_UNCERTAIN]
    error = (
        F.when(F.col("_known").isNull(), F.concat(unknown[0], label, unknown[1]))
        .when(~eligible, F.concat(head, label, middle, state, tail, F.lit(NOT_ELIGIBLE)))
        .when(F.col("_found").isNull(), F.concat(F.lit(FILE_GONE), F.col("archive_path")))
    )
    return joined.withColumn("error", error).drop("_known", "_found")


def mark_superseded(guarded: DataFrame) -> DataFrame:
    """Add ``superseded``: whether an accepted correction is followed by a later accepted one of its file.

    Both are carried out, one after the other; what the later one sets is what the file ends with. A
    refused correction neither is superseded nor supersedes another. Corrections without an id are one file.
    """
    held = settle_table(guarded)
    last = held.filter("error is null").groupBy(F.col("file_id").alias("_file")).agg(F.max("seq").alias("_last"))
    marked = held.join(last, F.col("file_id").eqNullSafe(F.col("_file")), "left")
    return marked.withColumn("superseded", F.col("error").isNull() & (F.col("seq") < F.col("_last"))).drop("_file", "_last")


def settle_step(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return settle_table(build())


def _groups(rows: DataFrame) -> DataFrame:
    """Add the group of names a correction asks a name of (``target``) and the one it gives a name up in (``home``).

    A group is a folder and a family of names: only names of one group can collide, and numbering
    leaves a file's family as it is.
    """
    path = F.col("archive_path")
    kin = family(F.col("name"))
    named = rows.withColumn("name", paths.file_name(path))
    return named.withColumns(
        {"target": F.concat_ws("/", "folder", kin), "home": F.concat_ws("/", paths.parent_folder(path), kin)}
    )


def ready_corrections(waiting: DataFrame) -> DataFrame:
    """The waiting corrections that can be planned together and end as if they had come one by one.

    A correction has to wait for an earlier one of its file, and for an earlier one that may give up a
    name in the group it asks in. One behind a waiting request of its target group would overtake it, and
    one that gives up a name behind such a request would show it a name that was not free yet; so they
    wait as well. The first of all never waits.
    """
    of_file = Window.partitionBy("file_id").orderBy("seq")
    rows = _groups(waiting).withColumn("_before", F.lag("target").over(of_file))
    rows = rows.withColumn("_gives", F.coalesce("_before", "home"))
    gives = rows.groupBy(F.col("_gives").alias("target")).agg(F.min("seq").alias("_given"))
    rows = spread_join(rows, gives, "target", "seq", "left")
    blocked = F.col("_before").isNotNull() | F.coalesce(F.col("_given") < F.col("seq"), F.lit(False))
    rows = settle_table(rows.withColumn("_blocked", blocked).drop("_before", "_gives", "_given"))
    count, before = rows.where("_blocked").count(), 0
    while count > before:
        first = rows.where("_blocked").groupBy("target").agg(F.min("seq").alias("_asked"))
        low, last = settle_table(first), rows
        rows = spread_join(rows, low, "target", "seq", "left").withColumnRenamed("_asked", "_own")
        rows = spread_join(rows, low.withColumnRenamed("target", "home"), "home", "seq", "left")
        behind = F.coalesce(F.col("_own") < F.col("seq"), F.lit(False)) | F.coalesce(F.col("_asked") < F.col("seq"), F.lit(False))
        rows = settle_table(rows.withColumn("_blocked", F.col("_blocked") | behind).drop("_own", "_asked"))
        before, count = count, rows.where("_blocked").count()
        discard_tables(low, last)
    return rows.where("not _blocked").drop("_blocked", "target", "home")


def serve_corrections(
    guarded: DataFrame,
    existing: DataFrame,
    archive_root: str,
    move: Callable[[DataFrame], DataFrame] | None = None,
    step: Callable[[str, Callable[[], DataFrame]], DataFrame] = settle_step,
) -> DataFrame:
    """Outcomes of the accepted corrections as if each was planned and moved after the one before.

    ``existing`` holds the names taken at the start (``archive_path`` of catalog and disk); a file
    corrected to the day it lies in gets a number, as its own name is taken. ``move`` carries out a
    plan (``archive_path, new_archive_path``, ...) and returns ``new_archive_path, outcome, error``;
    without it every move succeeds. A file whose move failed stays where it is for its later
    corrections, and the name that was meant for it is free again from the next round on. The result has ``seq, file_id, archive_path, corrected_date, new_archive_path, error``.

    Corrections run in rounds of those that do not depend on one another, mostly one round for each
    correction of the most corrected file; a round is a few jobs over all its corrections. ``step``
    keeps the table of a step, so that a batch run again finds what was planned and moved.
    """
    accepted = guarded.filter("error is null").select("seq", "file_id", "archive_path", "corrected_date")
    folder = paths.under_root(archive_root, paths.dated_folder(F.col("corrected_date")))
    waiting = step("accepted", lambda: accepted.withColumn("folder", folder))
    path = F.col("archive_path")
    names = existing.select(paths.parent_folder(path).alias("folder"), paths.file_name(path).alias("name"))
    names = names.withColumn("target", F.concat_ws("/", "folder", family(F.col("name"))))
    # Of the whole archive only the groups that some correction asks a name of are looked at again.
    taken = step("taken", lambda: names.join(_groups(waiting).select("target").distinct(), "target", "left_semi").select("folder", "name").distinct())
    served, number = [], 0
    while number == 0 or not waiting.isEmpty():
        planned = step(f"planned_{number}", lambda: _planned(ready_corrections(waiting), taken))
        done = planned.withColumn("error", F.lit(None).cast("string"))
        if move is not None:
            outcomes = step(f"outcomes_{number}", lambda: move(planned))
            failure = F.when(F.col("outcome") == "moved", None).otherwise(F.coalesce("error", F.lit("The file was not moved.")))
            told = outcomes.select("new_archive_path", F.lit(True).alias("_told"), failure.alias("error"))
            done = planned.join(told, "new_archive_path", "left")
            done = done.withColumn("error", F.when(F.col("_told"), F.col("error")).otherwise("The file was not moved."))
            done = done.select(*planned.columns, "error")
        served.append(done)
        rest = waiting.join(planned.select("seq"), "seq", "left_anti")
        moved = settle_table(done.filter("error is null").select("file_id", path.alias("_old"), F.col("new_archive_path").alias("_new")))
        waiting = settle_table(rest.join(moved, "file_id", "left").withColumn("archive_path", F.coalesce("_new", "archive_path")).drop("_old", "_new"))
        if not waiting.isEmpty():
            gone = moved.select(paths.parent_folder(F.col("_old")).alias("folder"), paths.file_name(F.col("_old")).alias("name"))
            new = moved.select(paths.parent_folder(F.col("_new")).alias("folder"), paths.file_name(F.col("_new")).alias("name"))
            taken = settle_table(taken.join(gone, ["folder", "name"], "left_anti").unionByName(new))
        number += 1
    return functools.reduce(DataFrame.unionByName, served)


def _planned(ready: DataFrame, taken: DataFrame) -> DataFrame:
    # Few rows against the names of their groups: written once for the jobs of the naming.
    asked = settle_table(ready.withColumnRenamed("seq", "id"))
    named = unique_destination(asked, taken)
    return named.select(
        F.col("id").alias("seq"), "file_id", "archive_path", "corrected_date",
        F.concat_ws("/", "folder", "dest_name").alias("new_archive_path"),
    )


def correction_results(guarded: DataFrame, served: DataFrame) -> DataFrame:
    """One result per correction: success and the new path, or the error."""
    outcome = served.select("seq", "new_archive_path", F.col("error").alias("_failure"))
    joined = guarded.join(outcome, "seq", "left").withColumn("error", F.coalesce("error", "_failure"))
    return joined.select(
        "seq", "file_id", F.col("error").isNull().alias("success"),
        F.when(F.col("error").isNull(), F.col("new_archive_path")).alias("new_archive_path"), "error",
    )


def apply_corrections(catalog: DataFrame, served: DataFrame, *, corrected_at: Column) -> DataFrame:
    """Catalog after the moves: new path, correction and time set, no longer uncertain.

    Of several corrections of one file the last one that was moved is what the catalog shows. What the
    analysis found (date, source, confidence, reason) stays as evidence.
    """
    last = F.max_by(F.struct("new_archive_path", "corrected_date"), "seq").alias("_last")
    change = served.filter("error is null").groupBy(F.col("file_id").alias("id")).agg(last)
    joined = catalog.join(change.select("id", F.col("_last.new_archive_path").alias("_path"), F.col("_last.corrected_date").alias("_date")), "id", "left")
    moved = F.col("_path").isNotNull()
    changed = joined.withColumns(
        {
            "archive_path": F.coalesce("_path", "archive_path"),
            "user_corrected_date": F.coalesce("_date", "user_corrected_date"),
            "corrected_at": F.when(moved, corrected_at).otherwise(F.col("corrected_at")),
            "date_uncertain": F.when(moved, 0).otherwise(F.col("date_uncertain")),
        }
    )
    return changed.select(*catalog.columns)
