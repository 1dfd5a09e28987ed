"""Every operator over the stand-in tables of a folder, as ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediadate import settings
from mediadate.functions import camera, dates, paths, sizes
from mediadate.operators import audit, duplicates, enrichment, importing, inventory, naming, ocr_text, review, scoring, signals
from mediadate.operators.lineage import settle_table
from mediadate.operators.skew import spread_join
from mediadate.plans import standins
from mediadate.sources import contents, metadata, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

IMAGE_TYPES = ("jpg", ".JPEG", "tif", "mp4")
FILTERS = settings.ImportFilters(
    min_file_size=2_000, max_file_size=180_000, exclude_path_contains=("/u13/", "/IMG_42"), require_exif=True
)
RUN = settings.ImportSettings(extensions=IMAGE_TYPES, archive_root=standins.ARCHIVE_ROOT, filters=FILTERS)
CONCLUSION = ["date_taken", "date_source", "filesystem_creation_date", "confidence", "date_reason", "date_uncertain"]
SIGNAL_COLUMNS = ["file_id", "seq", "source", "date", "base_confidence"]


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def as_of():
    return scoring.timestamp_literal(standins.AS_OF)


def located(spark, folder):
    photos = standins.view(spark, folder, "photos")
    return photos.select(
        F.col("file_id").alias("id"), F.col("path").alias("file_path"), paths.extension(F.col("path")).alias("file_extension"),
        "file_size", "creation_date", "modification_date", "status", F.lit(None).cast("string").alias("file_hash"),
    )


def present(spark, folder):
    photos = standins.view(spark, folder, "photos")
    return photos.filter("event_type <> 'click' or k >= 10").select("path", "file_size", "creation_date", "modification_date")


def outcomes(spark, folder, run=RUN):
    eligible = importing.eligible_files(located(spark, folder), run.extensions)
    tags = standins.evidence(spark, folder)
    return importing.import_outcomes(eligible, present(spark, folder), tags, run, as_of=as_of())


def copied(spark, folder):
    planned = importing.plan_destinations(outcomes(spark, folder))
    return planned.withColumn("outcome", F.lit("copied"))


# Inventory


@query
def inventory_scan(spark, folder):
    photos = standins.view(spark, folder, "photos")
    return inventory.scan_inventory(photos, ["JPG", ".jpeg", "tif"])


@query
def archive_listing(spark, folder):
    return inventory.archive_listing(standins.view(spark, folder, "site_files")).select("path", "file_size")


@query
def archive_listing_typed(spark, folder):
    files = standins.view(spark, folder, "site_files")
    return inventory.archive_listing(files, ["html", "gz"]).select("path", "file_size")


@query
def inventory_append(spark, folder):
    texts = standins.view(spark, folder, "texts")
    known = texts.filter("labeled").select(F.col("path").alias("file_path"))
    return inventory.append_new(known, _text_scan(texts))


def _text_scan(texts):
    moment = F.lit(None).cast("timestamp_ntz")
    manifest = texts.select("path", "file_size", moment.alias("creation_date"), moment.alias("modification_date"))
    return inventory.scan_inventory(manifest, ["txt"])


@query
def inventory_stream_step(spark, folder):
    """What one batch of the inventory stream writes: unknown files with the ids after the highest one."""
    texts = standins.view(spark, folder, "texts")
    known = texts.filter("labeled").select("id", F.col("path").alias("file_path"))
    return inventory.assign_ids(inventory.append_new(known, _text_scan(texts)), known)


@query
def inventory_append_counts(spark, folder):
    texts = standins.view(spark, folder, "texts")
    known = texts.filter("labeled").select(F.col("path").alias("file_path"))
    return inventory.append_counts(known, _text_scan(texts))


# Scoring


@query
def gather_signals(spark, folder):
    gathered = signals.gather_signals(standins.evidence(spark, folder))
    return signals.explode_signals(gathered).select(*SIGNAL_COLUMNS)


@query
def score_dates(spark, folder):
    gathered = signals.gather_signals(standins.evidence(spark, folder))
    return scoring.score_dates(gathered, as_of=as_of()).select("file_id", *CONCLUSION)


@query
def score_dates_long(spark, folder):
    photos = standins.evidence(spark, folder)
    long = signals.explode_signals(signals.gather_signals(photos))
    return scoring.score_dates_long(photos.select("file_id"), long, as_of=as_of(), threshold_days=3)


@query
def score_with_ocr(spark, folder):
    photos = standins.evidence(spark, folder)
    stamp = ocr_text.first_accepted(standins.view(spark, folder, "attempts"), as_of()).select("file_id", "ocr_date")
    gathered = signals.gather_signals(photos.join(stamp, "file_id", "left"), try_ocr=True)
    return scoring.score_dates(gathered, as_of=as_of()).select("file_id", *CONCLUSION)


@query
def archive_plan(spark, folder):
    scored = score_dates(spark, folder)
    target = importing.archive_folder(
        F.col("date_taken"), F.col("date_uncertain"), standins.ARCHIVE_ROOT, settings.REVIEW_FOLDER, as_of()
    )
    return scored.select("file_id", target.alias("archive_folder"))


# Import


@query
def eligible_files(spark, folder):
    return importing.eligible_files(located(spark, folder), IMAGE_TYPES).select("id", "file_path")


@query
def filter_cascade(spark, folder):
    photos = standins.view(spark, folder, "photos")
    reason = importing.exclude_reason(F.col("path"), F.col("file_size"), F.col("has_exif"), FILTERS)
    return photos.select("file_id", reason.alias("exclude_reason"), reason.isNull().alias("passes"))


@query
def import_outcomes(spark, folder):
    return outcomes(spark, folder).select("id", "outcome", "exclude_reason", "folder", "name", *CONCLUSION)


@query
def unique_destination(spark, folder):
    requests = outcomes(spark, folder).filter("outcome = 'planned'").select("id", "folder", "name")
    return naming.unique_destination(requests).select("id", "folder", "dest_name")


@query
def unique_destination_existing(spark, folder):
    """Against an archive that already holds numbered files, some of them leaving gaps."""
    requests = outcomes(spark, folder).filter("outcome = 'planned'").select("id", "folder", "name")
    photos = standins.view(spark, folder, "photos")
    number = (F.col("user_id") % 9).cast("string")
    taken = photos.select(
        paths.under_root(standins.ARCHIVE_ROOT, F.lit(settings.REVIEW_FOLDER)).alias("folder"),
        F.concat(F.lit("IMG_"), F.col("k"), F.when(number == "0", "").otherwise(F.concat(F.lit(" ("), number, F.lit(")"))), F.lit(".jpg")).alias("name"),
    )
    return naming.unique_destination(requests, taken).select("id", "folder", "dest_name")


@query
def unique_destination_numbered(spark, folder):
    """Sources that are themselves called ``name (n).ext`` compete with the numbers given out."""
    photos = standins.view(spark, folder, "photos")
    tail = F.when(F.col("value") > 40, F.concat(F.lit(" ("), F.col("user_id"), F.lit(")"))).otherwise("")
    requests = photos.select(
        F.col("file_id").alias("id"), F.concat(F.lit("/archive/"), F.col("event_type")).alias("folder"),
        F.concat(F.lit("IMG_"), F.col("k"), tail, F.lit(".jpg")).alias("name"),
    )
    return naming.unique_destination(requests).select("id", "folder", "dest_name")


@query
def import_records(spark, folder):
    done = settle_table(copied(spark, folder))
    held = done.filter("confidence = 98").select("archive_path")
    return importing.import_records(done, held, added_at=scoring.timestamp_literal(standins.ADDED_AT))


def copy_results(spark, folder):
    """Outcomes after copying: every ninth planned file meets a full disk."""
    done = F.when((F.col("outcome") == "planned") & (F.col("id") % 9 == 0), "failed").when(F.col("outcome") == "planned", "copied")
    return outcomes(spark, folder).withColumn("outcome", F.coalesce(done, F.col("outcome")))


@query
def copy_outcomes(spark, folder):
    """The inventory after a run in which some copies failed: those files keep their status."""
    return importing.update_status(located(spark, folder), copy_results(spark, folder)).select("id", "file_path", "status")


@query
def status_update(spark, folder):
    done = outcomes(spark, folder).withColumn("outcome", F.regexp_replace("outcome", "planned", "copied"))
    return importing.update_status(located(spark, folder), done).select("id", "file_path", "status")


@query
def import_summary(spark, folder):
    return importing.import_summary(copy_results(spark, folder))


# Audit


def audit_sides(spark, folder):
    return standins.archive_listing(spark, folder), standins.catalog(spark, folder)


@query
def audit_classify(spark, folder):
    return audit.classify(*audit_sides(spark, folder)).orderBy("path")


@query
def audit_missing(spark, folder):
    return audit.missing_files(*audit_sides(spark, folder))


@query
def audit_misplaced(spark, folder):
    return audit.misplaced_files(*audit_sides(spark, folder), standins.ARCHIVE_ROOT)


@query
def audit_undocumented(spark, folder):
    listing, catalog = audit_sides(spark, folder)
    return audit.undocumented_files(listing.drop("date_time_original", "date_time_digitized"), catalog, listing, standins.ARCHIVE_ROOT)


@query
def audit_summary(spark, folder):
    listing, catalog = audit_sides(spark, folder)
    return audit.audit_summary(listing, catalog, listing, standins.ARCHIVE_ROOT)


@query
def audit_report(spark, folder):
    """All sections of the audit report, each in the order of its paths."""
    found = audit_undocumented(spark, folder), audit_missing(spark, folder), audit_misplaced(spark, folder)
    entries = [rows.select(F.lit(name).alias("section"), "path") for name, rows in reports.audit_sections(*found).items()]
    every = functools.reduce(DataFrame.unionByName, entries)
    return reports.number_rows(every, [F.col("section"), F.col("path")])


@query
def audit_diff(spark, folder):
    """Summary before and after a person's corrections."""
    listing, catalog = audit_sides(spark, folder)
    plain = catalog.withColumn("user_corrected_date", F.lit(None).cast("timestamp_ntz"))
    before = audit.audit_summary(listing, plain, listing, standins.ARCHIVE_ROOT)
    after = audit.audit_summary(listing, catalog, listing, standins.ARCHIVE_ROOT)
    return audit.summary_changes(before, after)


@query
def effective_date(spark, folder):
    """Over a catalog that holds its dates as text, some of them no dates."""
    rows = standins.view(spark, folder, "archived")
    taken = F.when(F.col("o_totalprice") < 50000, "no date").otherwise(dates.iso_text(F.col("date_taken")))
    text = rows.select(
        "id", taken.alias("date_taken"), F.coalesce(dates.iso_text(F.col("user_corrected_date")), F.lit("")).alias("user_corrected_date")
    )
    return text.select("id", audit.effective_date(text).alias("effective_date"))


@query
def folder_parts(spark, folder):
    rows = standins.view(spark, folder, "archived")
    expected = paths.dated_folder(F.col("date_taken"))
    return rows.select(
        "id", paths.placed_folder(F.col("path"), standins.ARCHIVE_ROOT).alias("actual_folder"), expected.alias("expected_folder"),
        F.concat_ws("/", expected, paths.file_name(F.col("path"))).alias("expected_relative_path"),
    )


# Duplicates


def text_entries(spark, folder):
    files = standins.text_files(spark, folder)
    catalog = files.filter("labeled").select(
        F.col("path").alias("archive_path"), F.when(F.col("toxic") == 0, F.col("file_size")).alias("file_size"), "file_hash"
    )
    unhashed = duplicates.unhashed_files(files, catalog)
    return duplicates.archive_entries(files.select("path", "file_size"), catalog, standins.text_hashes(spark, folder, unhashed))


@query
def content_hash(spark, folder):
    texts = standins.view(spark, folder, "texts")
    return texts.select("id", contents.content_hash(F.col("text")).alias("file_hash"))


@query
def hash_cache_fill(spark, folder):
    files = standins.text_files(spark, folder)
    records = files.filter("labeled").select(F.col("path").alias("file_path"), "file_hash")
    missing = duplicates.missing_hashes(records, files)
    return duplicates.fill_hashes(records, standins.text_hashes(spark, folder, missing, "file_path"))


@query
def audit_hash_fill(spark, folder):
    """Catalog files on disk with their hash, computed where the catalog has none."""
    files = standins.text_files(spark, folder)
    listing = files.filter("lang <> 'fr'").select("path")
    catalog = files.filter("labeled").select(F.col("path").alias("archive_path"), "file_hash")
    matched = audit.classify(listing, catalog).filter("section = 'matched'")
    missing = duplicates.missing_hashes(catalog, matched, "archive_path")
    hashes = standins.text_hashes(spark, folder, missing, "archive_path")
    return duplicates.fill_hashes(catalog.join(matched.select(F.col("path").alias("archive_path")), "archive_path", "left_semi"), hashes, "archive_path")


@query
def dup_archive_entries(spark, folder):
    return text_entries(spark, folder).drop("position")


@query
def dup_source_entries(spark, folder):
    files = standins.text_files(spark, folder)
    records = files.withColumnRenamed("path", "file_path")
    missing = duplicates.missing_hashes(records.filter("status = 'located'"), files)
    return duplicates.source_entries(records, standins.text_hashes(spark, folder, missing, "file_path"))


@query
def dup_groups(spark, folder):
    return duplicates.report_order(duplicates.duplicate_groups(text_entries(spark, folder)))


@query
def dup_members(spark, folder):
    return duplicates.duplicate_members(text_entries(spark, folder))


@query
def dup_report(spark, folder):
    """The duplicate report as lines: groups by the bytes they waste, each followed by its files."""
    entries = settle_table(text_entries(spark, folder))
    groups = settle_table(duplicates.duplicate_groups(entries))
    members = duplicates.duplicate_members(entries, groups.select("file_hash", "count"))
    members = spread_join(members, groups.select("file_hash", "wasted_bytes", "first_path"), "file_hash", "path")
    lines = reports.duplicate_section(groups, members).where("step < 2").select("wasted_bytes", "first_path", "step", "path")
    return reports.number_rows(lines, [F.desc("wasted_bytes"), F.asc("first_path"), F.asc("step"), F.asc("path")])


@query
def dup_summary(spark, folder):
    return duplicates.duplicate_summary(text_entries(spark, folder))


@query
def dup_cache_counters(spark, folder):
    return duplicates.archive_cache_counters(text_entries(spark, folder))


@query
def dup_cache_counters_source(spark, folder):
    files = standins.text_files(spark, folder)
    there = files.filter("lang <> 'de'").select("path")
    records = files.withColumnRenamed("path", "file_path")
    missing = duplicates.missing_hashes(records, there)
    hashes = standins.text_hashes(spark, folder, missing, "file_path")
    return duplicates.source_cache_counters(records, there, hashes, ("located", "imported"))


# Review


@query
def review_queue(spark, folder):
    listing, catalog = audit_sides(spark, folder)
    return review.review_queue(catalog, listing)


@query
def review_top_n(spark, folder):
    listing, catalog = audit_sides(spark, folder)
    return review.review_top(catalog, listing, 25)


@query
def file_details(spark, folder):
    listing, catalog = audit_sides(spark, folder)
    return review.file_details(catalog, listing, 78)


def guarded(spark, folder):
    listing, catalog = audit_sides(spark, folder)
    return review.guard_corrections(standins.view(spark, folder, "corrections"), catalog, listing)


def served_corrections(spark, folder, move=None):
    taken = standins.view(spark, folder, "archived").select(F.col("path").alias("archive_path"))
    held = settle_table(guarded(spark, folder))
    return held, review.serve_corrections(held, taken, standins.ARCHIVE_ROOT, move)


def full_disk(planned):
    """What a mover reports: every seventh correction meets a full disk."""
    failed = F.col("seq") % 7 == 0
    return planned.select(
        "new_archive_path", F.when(failed, "failed").otherwise("moved").alias("outcome"), F.when(failed, "No space left on device").alias("error")
    )


@query
def correction_guard(spark, folder):
    return review.mark_superseded(guarded(spark, folder)).select("seq", "file_id", "error", "superseded")


@query
def correction_results(spark, folder):
    return review.correction_results(*served_corrections(spark, folder))


@query
def correction_moves(spark, folder):
    return review.correction_results(*served_corrections(spark, folder, full_disk))


@query
def apply_moved_corrections(spark, folder):
    stamp = scoring.timestamp_literal(standins.ADDED_AT)
    return review.apply_corrections(standins.catalog(spark, folder), served_corrections(spark, folder, full_disk)[1], corrected_at=stamp)


@query
def apply_corrections(spark, folder):
    stamp = scoring.timestamp_literal(standins.ADDED_AT)
    return review.apply_corrections(standins.catalog(spark, folder), served_corrections(spark, folder)[1], corrected_at=stamp)


# Date texts and other scalar groups


@query
def exif_dates(spark, folder):
    texts = standins.view(spark, folder, "date_texts")
    found = dates.exif_date(F.col("original"), F.col("digitized"))
    return texts.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found["date"].alias("date"), found["source"].alias("source"))


@query
def tiff_dates(spark, folder):
    texts = standins.view(spark, folder, "date_texts")
    return texts.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.camera_date(F.col("original")).alias("date"))


@query
def gps_dates(spark, folder):
    texts = standins.view(spark, folder, "date_texts")
    clock = F.when(F.col("l_returnflag") != "A", F.array("hour_part", "minute_part", "second_part"))
    return texts.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.gps_date(F.col("gps_stamp"), clock).alias("date"))


@query
def xmp_dates(spark, folder):
    texts = standins.view(spark, folder, "date_texts")
    return texts.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.xmp_date(F.col("iso")).alias("date"))


@query
def iso_dates(spark, folder):
    events = standins.table(spark, folder, "events")
    whole = F.substring(F.col("ts").cast("string"), 1, 19).cast("timestamp_ntz")
    moment = F.when(F.col("event_type") == "view", whole).otherwise(F.col("ts"))
    return events.select("event_id", dates.iso_text(moment).alias("iso"))


@query
def gps_decimal(spark, folder):
    texts = standins.view(spark, folder, "date_texts")
    dms = F.array("l_quantity", "hour_part", F.col("second_part"))
    ref = F.when(F.col("l_returnflag") == "A", "S").when(F.col("l_returnflag") == "N", "E")
    return texts.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", camera.decimal_degrees(dms, ref).alias("degrees"))


@query
def camera_info(spark, folder):
    part = standins.table(spark, folder, "part")
    make = F.when(F.col("p_size") > 3, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))).otherwise("")
    fields = camera.camera_fields(make, F.col("p_type"), F.col("p_retailprice") / 4, F.col("p_size"), F.col("p_retailprice") / 8)
    return part.select("p_partkey", *fields)


@query
def format_size(spark, folder):
    lines = standins.view(spark, folder, "date_texts")
    size = F.floor(F.pow(F.col("l_quantity"), F.col("l_linenumber").cast("double")) * 256)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sizes.format_size(size).alias("size"))


@query
def path_parts(spark, folder):
    files = standins.view(spark, folder, "site_files")
    name = paths.file_name(F.col("path"))
    return files.select(
        "page_id", name.alias("name"), paths.suffix(name).alias("suffix"), paths.stem(name).alias("stem"),
        paths.extension(F.col("path")).alias("extension"), paths.relative_path(F.col("path"), "/archive").alias("relative"),
    )


@query
def ocr_text_date(spark, folder):
    attempts = standins.view(spark, folder, "attempts")
    read = ocr_text.read_stamps(attempts, as_of())
    return read.select("attempt_seq", "stamp_date", "punctuated", "accepted")


@query
def ocr_attempt_text(spark, folder):
    return ocr_text.attempt_texts(standins.view(spark, folder, "words"))


@query
def ocr_first_accepted(spark, folder):
    return ocr_text.first_accepted(standins.view(spark, folder, "attempts"), as_of())


@query
def ocr_checked(spark, folder):
    return ocr_text.checked_attempts(standins.view(spark, folder, "attempts"), as_of())


@query
def xmp_signal(spark, folder):
    texts = standins.view(spark, folder, "archived")
    created = F.concat(F.lit("<xmp:CreateDate>"), dates.iso_text(F.col("date_taken")), F.lit("</xmp:CreateDate>"))
    broken = F.lit("<xmp:CreateDate>2024</xmp:CreateDate>")
    pieces = [
        F.when(F.col("o_orderstatus") == "P", created).when(F.col("o_orderstatus") == "F", broken).otherwise(""),
        F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("<photoshop:DateCreated>"), dates.iso_text(F.col("date_added")), F.lit("Z</photoshop:DateCreated>"))).otherwise(""),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("<xmp:ModifyDate> "), dates.iso_text(F.col("creation_date")), F.lit("</xmp:ModifyDate>"))).otherwise(""),
    ]
    packet = F.concat(F.lit(standins.PACKET.split("{1}")[0].replace("{0}", "xmp")), *pieces, F.lit(standins.PACKET.split("{1}")[1]))
    read = texts.select("id", metadata.xmp_fields(packet).alias("x"))
    read = read.select("id", dates.first_xmp_date(F.col("x.xmp_create_date"), F.col("x.photoshop_date_created"), F.col("x.xmp_modify_date")).alias("f"))
    return read.select("id", "f.date", "f.source")


@query
def metadata_extract(spark, folder):
    photos = standins.view(spark, folder, "photos")
    stamp = F.regexp_replace(F.substring(F.col("ts").cast("string"), 1, 19), "-", ":")
    maker = F.concat(F.lit("Maker"), F.lpad(F.col("k").cast("string"), 10, "0"))
    body = "<ns:CreateDate>{}</ns:CreateDate>"
    head, tail = standins.PACKET.replace("{0}", "ns").replace("{1}", body).split("{}")
    created = F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    packet = F.concat(F.lit(head), created, F.lit(tail))
    content = standins.jpeg_bytes(stamp, maker, F.col("user_id"), packet, len(head) + 19 + len(tail))
    # A JPEG's EXIF block is a TIFF file of its own.
    content = F.when(F.col("path").endswith(".tif"), F.substring(content, 13, 2**20)).otherwise(content)
    content = F.when(F.col("event_type") == "error", F.encode(F.col("k").cast("string"), "UTF-8")).otherwise(content)
    found = metadata.extract_metadata(photos.select("file_id", "path", content.alias("content")))
    return found.select(
        "file_id", "path", "has_exif", "date_time_original", "date_time_digitized", "tiff_datetime", "xmp_create_date",
        "xmp_modify_date", "make", "model", "aperture", "iso_speed", "focal_length_mm", "error",
    )


# Further signals and follow-up work


def text_catalog(spark, folder):
    files = standins.text_files(spark, folder)
    day = F.expr("timestamp_ntz '2020-01-01 00:00:00' + interval '1' day * id")
    return files.filter("labeled").select(
        "id", F.col("path").alias("archive_path"), "file_hash", day.alias("date_taken"),
        F.when(F.col("toxic") == 1, F.expr("timestamp_ntz '2010-01-01 00:00:00' + interval '1' day * id")).alias("user_corrected_date"),
        F.when(F.length("text") > 500, 95).otherwise(30).alias("confidence"),
    )


def hashed_texts(spark, folder):
    texts = standins.view(spark, folder, "texts")
    return texts.select(F.col("id").alias("file_id"), "path", contents.content_hash(F.col("text")).alias("file_hash"))


@query
def hash_twin_signal(spark, folder):
    return enrichment.hash_twin_signals(hashed_texts(spark, folder), text_catalog(spark, folder))


def dated_names(spark, folder):
    rows = standins.view(spark, folder, "archived")
    day = F.substring(F.col("date_taken").cast("string"), 1, 10)
    clock = F.substring(F.col("date_taken").cast("string"), 12, 8)
    compact = F.concat(F.lit("IMG_"), F.replace(day, F.lit("-"), F.lit("")), F.lit("_"), F.replace(clock, F.lit(":"), F.lit("")), F.lit(".jpg"))
    meeting = F.concat(F.lit("Meeting "), day, F.lit(" notes.mp3"))
    number = F.concat(F.lit("scan"), F.col("id"), F.lit("123456789.jpg"))
    name = F.when(F.col("o_orderstatus") == "P", compact).when(F.col("o_orderstatus") == "F", meeting).otherwise(number)
    return rows.select(F.col("id").alias("file_id"), F.concat(F.lit("/in/"), F.col("id"), F.lit("/"), name).alias("path"), "date_taken")


@query
def filename_signal(spark, folder):
    return enrichment.filename_signals(dated_names(spark, folder))


@query
def folder_signal(spark, folder):
    files = standins.view(spark, folder, "archived").select(F.col("id").alias("file_id"), "path")
    return enrichment.folder_signals(files)


@query
def sidecar_signal(spark, folder):
    photos = standins.view(spark, folder, "photos")
    seconds = F.floor(F.col("value") * 1_000_000).cast("string")
    export = F.concat(F.lit('{"photoTakenTime": {"timestamp": "'), seconds, F.lit('"}}'))
    none = F.lit(None).cast("string")
    takeout = photos.filter("k < 50").select(F.concat("path", F.lit(".supplemental-metadata.json")).alias("path"), export.alias("content"), none.alias("date_time_original"))
    xmp = photos.filter("k >= 40").select(F.regexp_replace("path", r"\.[^.]+$", ".xmp").alias("path"), F.col("xmp_create_date").alias("content"), none.alias("date_time_original"))
    thumb = photos.filter("event_type = 'error'").select(F.regexp_replace("path", r"\.[^.]+$", ".THM").alias("path"), none.alias("content"), F.col("tiff_datetime").alias("date_time_original"))
    return enrichment.sidecar_signals(photos.select("file_id", "path"), takeout.unionByName(xmp).unionByName(thumb))


@query
def sequence_signal(spark, folder):
    rows = standins.view(spark, folder, "archived")
    files = rows.select(
        F.col("id").alias("file_id"), F.concat(F.lit("/dcim/"), F.substring("o_orderpriority", 1, 1), F.lit("/IMG_"), F.col("id"), F.lit(".jpg")).alias("path"),
        F.when(F.col("o_orderstatus") != "P", F.expr("timestamp_ntz '2020-01-01 00:00:00' + interval '1' hour * id")).alias("date"),
    )
    return enrichment.sequence_signals(files)


@query
def dup_date_conflicts(spark, folder):
    return enrichment.date_conflicts(text_entries(spark, folder), standins.ARCHIVE_ROOT)


@query
def audit_fix_plan(spark, folder):
    return enrichment.fix_plan(*audit_sides(spark, folder), standins.ARCHIVE_ROOT)


@query
def import_skip_dupes(spark, folder):
    return enrichment.skip_identical(hashed_texts(spark, folder), text_catalog(spark, folder)).select("file_id", "path")


@query
def rescore_uncertain(spark, folder):
    photos = standins.evidence(spark, folder)
    gathered = signals.gather_signals(photos)
    scored = scoring.score_dates(gathered, as_of=as_of())
    named = photos.select("file_id", F.concat(F.lit("/in/IMG_"), F.replace(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("-"), F.lit("")), F.lit(".jpg")).alias("path"))
    extra = enrichment.filename_signals(named)
    return enrichment.rescore_uncertain(scored, signals.explode_signals(gathered), extra, as_of=as_of())


@query
def label_search(spark, folder):
    part = standins.table(spark, folder, "part")
    labels = part.groupBy(F.col("p_type").alias("label_name")).agg(F.min("p_partkey").alias("id")).withColumn("category", F.lit("thing"))
    links = standins.table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    links = links.join(labels.select("label_name", F.col("id").alias("label_id")), F.col("p_type") == F.col("label_name"))
    file_labels = links.select(F.col("l_orderkey").alias("file_id"), "label_id", F.when(F.col("l_returnflag") == "A", "ai").otherwise("user").alias("source")).distinct()
    catalog = standins.catalog(spark, folder).select("id", "archive_path")
    return enrichment.label_search(catalog, labels, file_labels, "ECONOMY")
