"""Further date signals and follow-up work the archive's design describes.

Every function that finds dates returns them in long form ``(file_id, seq, source, date,
base_confidence)``, ready to be appended to the standard signals of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediadate import settings
from mediadate.functions import dates, paths
from mediadate.operators import audit, duplicates
from mediadate.operators.lineage import settle_table
from mediadate.operators.naming import unique_destination
from mediadate.operators.scoring import score_dates
from mediadate.operators.skew import BROADCAST_ROWS, spread_join

# Date forms in file and folder names, as year, month, day and an optional time.
NAME_DATE = r"(?<!\d)((?:19|20)\d\d)([-_.]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])(?:[-_T ]?([01]\d|2[0-3])[-_.]?([0-5]\d)[-_.]?([0-5]\d))?(?!\d)"
FOLDER_DATE = r"(?:^|/)((?:19|20)\d\d)[-_/.](0[1-9]|1[0-2])[-_/.](0[1-9]|[12]\d|3[01])(?:/|\z|[^\d/][^/]*(?:/|\z))"
NUMBERED_NAME = r"^(.*?)(\d+)\z"

SEQ = {source: 10 + i for i, source in enumerate(settings.EXTRA_CONFIDENCE)}


def _signals(rows: DataFrame, source: str, date: Column) -> DataFrame:
    found = rows.select(
        "file_id", F.lit(SEQ[source]).alias("seq"), F.lit(source).alias("source"), date.alias("date"),
        F.lit(settings.EXTRA_CONFIDENCE[source]).alias("base_confidence"),
    )
    return found.filter("date is not null")


def hash_twin_signals(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Date of an archived file with the same bytes: a correction, else a high-confidence date."""
    trusted = F.col("user_corrected_date").isNotNull() | (F.col("confidence") >= settings.TRUSTED_CONFIDENCE)
    dated = catalog.filter(trusted & duplicates.known_hash(F.col("file_hash")).isNotNull())
    rank = F.struct(F.col("user_corrected_date").isNotNull(), F.col("confidence"), -F.col("id"))
    best = dated.groupBy("file_hash").agg(
        F.max_by(F.coalesce("user_corrected_date", "date_taken"), rank).alias("_date")
    )
    twins = spread_join(files.select("file_id", "file_hash"), best, "file_hash", "file_id")
    return _signals(twins, "hash_twin", F.col("_date"))


def _text_date(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    part = [F.regexp_extract(text, pattern, g).try_cast("int") for g in groups]
    clock = [F.coalesce(p, F.lit(0)) for p in part[3:]]
    return dates.timestamp_of(*part[:3], *clock)


def filename_signals(files: DataFrame) -> DataFrame:
    """Date, with an optional time, in the file name."""
    name = paths.stem(paths.file_name(F.col("path")))
    return _signals(files, "filename_pattern", _text_date(name, NAME_DATE, (1, 3, 4, 5, 6, 7)))


def folder_signals(files: DataFrame) -> DataFrame:
    """Full date in a folder name or in nested year, month and day folders."""
    return _signals(files, "folder_pattern", _text_date(paths.parent_folder(F.col("path")), FOLDER_DATE, (1, 2, 3)))


def sidecar_signals(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Dates of the files that lie next to a media file under its name.

    ``sidecars`` holds ``path``, ``content`` (JSON of a Takeout export or the create date of an XMP
    file) or ``date_time_original`` (THM). They are evidence, never archived themselves.
    """
    path = F.col("path")

    def pair(name):
        return F.struct(paths.parent_folder(path).alias("folder"), name.alias("name"))

    name = paths.file_name(path)
    bare = F.regexp_replace(name, r"(?i)(\.supplemental-metadata)?\.(json|xmp|thm)\z", "")
    kind = paths.extension(path)
    seconds = F.get_json_object("content", "$.photoTakenTime.timestamp").try_cast("long")
    # Seconds outside the years 1 to 9999 (a stamp in milliseconds, say) are no date.
    seconds = F.when(seconds.between(-62_135_596_800, 253_402_300_799), seconds)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    date = (
        F.when(kind == ".json", epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
        .when(kind == ".xmp", dates.xmp_date(F.col("content")))
        .when(kind == ".thm", dates.camera_date(F.col("date_time_original")))
    )
    source = F.when(kind == ".json", "takeout_json").when(kind == ".xmp", "sidecar_xmp").when(kind == ".thm", "sidecar_thm")
    evidence = sidecars.select(pair(bare).alias("_pair"), source.alias("source"), date.alias("date"))
    evidence = evidence.filter("source is not null and date is not null")
    # One sidecar of a kind speaks for a file: the earliest date, whatever their number.
    evidence = evidence.groupBy("_pair", "source").agg(F.min("date").alias("date"))
    # A sidecar repeats the whole name of its file or only the part before the suffix.
    media = files.select("file_id", F.explode(F.array_distinct(F.array(pair(name), pair(paths.stem(name))))).alias("_pair"))
    found = media.join(evidence, "_pair").groupBy("file_id", "source").agg(F.min("date").alias("date"))
    number = F.create_map(*[F.lit(x) for s in SEQ.items() for x in s])
    base = F.create_map(*[F.lit(x) for s in settings.EXTRA_CONFIDENCE.items() for x in s])
    return found.select("file_id", number[F.col("source")].alias("seq"), "source", "date", base[F.col("source")].alias("base_confidence"))


def sequence_signals(files: DataFrame) -> DataFrame:
    """Date of an undated numbered file whose numbered neighbors on both sides share a day.

    ``files`` holds ``file_id, path`` and ``date`` (null when undated). The nearest dated number on
    each side is found per block of a million numbers and carried across blocks, so a folder with a
    third of all files is no single window. Numbers have any length: a block is the count of digits
    and all digits but the last six, which sorts as text, and the place in it the last six.
    """
    stem = paths.stem(paths.file_name(F.col("path")))
    digits = F.regexp_replace(F.regexp_extract(stem, NUMBERED_NAME, 2), r"^0+(?=\d)", "")
    size = F.length("digits")
    named = files.select(
        "file_id", "date", paths.parent_folder(F.col("path")).alias("folder"),
        F.regexp_extract(stem, NUMBERED_NAME, 1).alias("prefix"), digits.alias("digits"),
    )
    series = ["folder", "prefix"]
    block = F.concat(F.lpad(size.cast("string"), 5, "0"), F.left("digits", F.greatest(size - 6, F.lit(0))))
    named = named.withColumns({"block": block, "number": F.right("digits", F.lit(6)).try_cast("int")}).drop("digits")
    # Written once: filters and joins below would each parse every path again, pattern by pattern.
    numbered = settle_table(named).filter("number is not null")
    # The dated neighbor is a number; its date is the earliest of the files that carry the number.
    points = numbered.filter("date is not null").groupBy(*series, "block", "number").agg(F.min("date").alias("date"))
    mark = F.struct("number", "date")
    edges = numbered.select(*series, "block").distinct().join(
        points.groupBy(*series, "block").agg(F.max(mark).alias("last"), F.min(mark).alias("first")), [*series, "block"], "left"
    )
    below = Window.partitionBy(*series).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy(*series).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *series, "block",
        F.last("last", True).over(below).alias("left"),
        F.last("first", True).over(beyond).alias("right"),
    )
    # Both windows grow row by row; one that ran from the next number to the end of its block would be
    # summed up anew for every row. The number after is the last one seen from above.
    inside = Window.partitionBy(*series, "block").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*series, "block").orderBy(F.desc("number")).rangeBetween(Window.unboundedPreceding, -1)
    marked = numbered.join(points.withColumnRenamed("date", "point"), [*series, "block", "number"], "left")
    here = F.when(F.col("point").isNotNull(), F.struct("number", F.col("point").alias("date")))
    marked = marked.withColumns(
        {
            "before": F.last(here, True).over(inside),
            "after": F.last(here, True).over(above),
        }
    ).join(edges, [*series, "block"])
    before, after = F.coalesce("before", "left"), F.coalesce("after", "right")
    same_day = F.to_date(before["date"]) == F.to_date(after["date"])
    return _signals(marked.filter("date is null"), "sequence_neighbor", F.when(same_day, before["date"]))


def date_conflicts(entries: DataFrame, archive_root: str) -> DataFrame:
    """Groups of identical files that lie in different day folders."""
    placed = entries.withColumn("_folder", paths.placed_folder(F.col("path"), archive_root))
    # Distinct folders per hash first: that halves what the second aggregation sees of a hot hash.
    per_folder = placed.filter("_folder is not null").groupBy("file_hash", "_folder").agg(F.count(F.lit(1)).alias("n"))
    groups = per_folder.groupBy("file_hash").agg(
        F.sum("n").alias("files"), F.count(F.lit(1)).alias("folders"),
        F.min("_folder").alias("first_folder"), F.max("_folder").alias("last_folder"),
    )
    return groups.filter("folders > 1")


def fix_plan(listing: DataFrame, catalog: DataFrame, archive_root: str) -> DataFrame:
    """What would bring disk and catalog together again; nothing is carried out.

    Disk and catalog meet once. Moves are served by catalog ``id`` against the names on either side,
    so that no target is taken or given out twice.
    """
    path = F.col("path")
    disk = listing.select("path", F.lit(True).alias("on_disk"))
    records = catalog.select(
        F.col("archive_path").alias("path"), "id", paths.dated_folder(audit.effective_date(catalog)).alias("expected"), F.lit(True).alias("known")
    )
    both = disk.join(records, "path", "full_outer").withColumns(
        {"folder": paths.parent_folder(path), "name": paths.file_name(path)}
    )
    misplaced = F.col("expected") != paths.placed_folder(path, archive_root)
    action = (
        F.when(F.col("known").isNull(), "add_to_catalog").when(F.col("on_disk").isNull(), "drop_from_catalog").when(misplaced, "move")
    )
    both = settle_table(both.select("id", "path", "folder", "name", "expected", action.alias("action")))
    moves = both.filter("action = 'move'").select(
        "id", "path", paths.under_root(archive_root, F.col("expected")).alias("folder"), "name"
    )
    planned = unique_destination(settle_table(moves), both.select("folder", "name"))
    planned = planned.select(F.lit("move").alias("action"), "path", F.concat_ws("/", "folder", "dest_name").alias("target"))
    others = both.filter("action <> 'move'").select("action", "path", F.lit(None).cast("string").alias("target"))
    return others.unionByName(planned)


def skip_identical(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files to import whose bytes the archive does not hold yet, the first path of each content.

    The first one is a minimum, combined before the shuffle, so a content that most files share
    leaves one row per task. Files without a hash are all kept.
    """
    held = catalog.select(duplicates.known_hash(F.col("file_hash")).alias("file_hash")).filter("file_hash is not null")
    row = F.struct(*candidates.columns)
    hashed = candidates.filter("file_hash is not null")
    first = hashed.groupBy("file_hash").agg(F.min_by(row, "path").alias("_row")).select("_row.*")
    return first.join(held.distinct(), "file_hash", "left_anti").select(*candidates.columns).unionByName(candidates.filter("file_hash is null"))


def rescore_uncertain(
    scored: DataFrame, long_signals: DataFrame, extra_signals: DataFrame, *, as_of: Column, threshold_days: int = 1
) -> DataFrame:
    """Score uncertain files again with further signals; the others are left out."""
    unsure = scored.filter("date_uncertain = 1").select("file_id")
    columns = ["file_id", "seq", "source", "date", "base_confidence"]
    everything = long_signals.select(*columns).unionByName(extra_signals.select(*columns))
    wanted = everything.join(unsure, "file_id", "left_semi")
    one = F.struct("seq", "source", "date", "base_confidence")
    wide = wanted.groupBy("file_id").agg(F.array_sort(F.collect_set(one)).alias("signals"))
    labels = {**settings.SOURCE_LABELS, **settings.EXTRA_LABELS}
    return score_dates(wide, as_of=as_of, threshold_days=threshold_days, labels=labels).drop("signals")


def label_search(catalog: DataFrame, labels: DataFrame, file_labels: DataFrame, label_name: str) -> DataFrame:
    """Catalog rows that carry a label, with where the label came from.

    The ids of the label's name are few as a rule and then sent to the files' labels; a larger number of
    them meets salted keys. So the files of a label that most files carry stay spread by their own ids.
    """
    wanted = labels.filter(F.col("label_name") == label_name).select(F.col("id").alias("label_id"), "label_name", "category")
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = file_labels.join(F.broadcast(wanted), "label_id")
    else:
        met = spread_join(file_labels, wanted, "label_id", "file_id")
    tagged = met.select(F.col("file_id").alias("id"), "label_name", "category", F.col("source").alias("label_source"))
    return catalog.join(tagged, "id")
