"""Inventory, duplicates, audit, corrections and streams on small tables and real files."""

import hashlib
import json
import math
import os
import random
import struct
from collections import Counter
from datetime import datetime, timedelta
from pathlib import PurePosixPath

import duckdb
import pytest
from pyspark.sql import functions as F

from mediadate import schemas, settings
from mediadate.operators import audit, duplicates, enrichment, inventory, review
from mediadate.operators.ordering import running_total
from mediadate.operators.scoring import timestamp_literal
from mediadate.plans import oracles, queries
from mediadate.plans.import_run import run_import
from mediadate.sources import bucketed, contents, listing, metadata, reports
from mediadate.sources.snapshots import AppendTable, ChangeTable, Part, SnapshotTable, covering, due_merge, write_report
from mediadate.streaming import tables

def now():
    return timestamp_literal("2024-06-15 12:00:00")


def tiff_block(order, date=b"2020:01:02 03:04:05\x00", gps=True):
    """Bytes of a directory with make, date, EXIF and GPS parts."""
    mark = order + "HHII"
    main, exif, gps_at, data = 8, 8 + 2 + 48 + 4, 8 + 2 + 48 + 4 + 2 + 36 + 4, 8 + 2 + 48 + 4 + 2 + 36 + 4 + 2 + 48 + 4
    out = (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "I", main)
    out += struct.pack(order + "H", 4) + struct.pack(mark, 0x010F, 2, 6, data) + struct.pack(mark, 0x0132, 2, 20, data + 6)
    out += struct.pack(mark, 0x8769, 4, 1, exif) + struct.pack(mark, 0x8825, 4, 1, gps_at) + bytes(4)
    iso = struct.pack(order + "HHIHH", 0x8827, 3, 1, 400, 0)
    out += struct.pack(order + "H", 3) + struct.pack(mark, 0x9003, 2, 20, data + 6) + iso + struct.pack(mark, 0x829D, 5, 1, data + 26) + bytes(4)
    out += struct.pack(order + "H", 4) + struct.pack(order + "HHI4s", 1, 2, 2, b"S\x00\x00\x00") + struct.pack(mark, 2, 5, 3, data + 34)
    out += struct.pack(mark, 7, 5, 3, data + 58) + struct.pack(mark, 29, 2, 11, data + 82) + bytes(4)
    out += b"Maker\x00" + date + struct.pack(order + "II", 14, 5)
    out += struct.pack(order + "6I", 10, 1, 30, 1, 36, 1) + struct.pack(order + "6I", 3, 1, 4, 1, 11, 2) + b"2020:01:03\x00"
    return out


def jpeg(block=b"", xmp=b""):
    def segment(body):
        return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body if body else b""

    exif = segment(b"Exif\x00\x00" + block) if block else b""
    packet = segment(b"http://ns.adobe.com/xap/1.0/\x00" + xmp) if xmp else b""
    return b"\xff\xd8" + exif + packet + b"\xff\xda\x00\x02picture\xff\xd9"


XMP = (b'<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:q="http://ns.adobe.com/xap/1.0/"><a q:CreateDate="2001-01-01">'
       b"<q:ModifyDate>2019-05-06T07:08:09Z</q:ModifyDate></a></x:xmpmeta>")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    files = {
        "a/one.jpg": jpeg(tiff_block(">")), "a/two.JPG": jpeg(tiff_block("<"), XMP), "b/one.jpg": jpeg(tiff_block(">")),
        "b/scan.tif": tiff_block("<"), "b/.hidden/_odd.jpg": jpeg(xmp=b"<no xml"), "b/clip.mp4": b"junk", "b/empty.jpg": b"",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


@pytest.mark.parametrize("with_content", [False, True])
def test_metadata(spark, tree, with_content):
    files = listing.walk_folders(spark, str(tree)).withColumn("file_id", F.col("path"))
    if with_content:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tree))
        files = read.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content").withColumn("file_id", F.col("path"))
    rows = {os.path.relpath(r.path, tree): r for r in metadata.extract_metadata(files).collect()}
    for name in ("a/one.jpg", "a/two.JPG"):
        row = rows[name]
        assert (row.has_exif, row.make, row.aperture, row.iso_speed) == (True, "Maker", "f/2.8", "400")
        assert row.date_time_original == row.tiff_datetime == "2020:01:02 03:04:05"
        assert (row.gps_lat, row.gps_lat_ref, row.gps_date_stamp) == ([10.0, 30.0, 36.0], "S", "2020:01:03")
        assert row.gps_time_stamp == [3.0, 4.0, 5.5]
    assert (rows["a/two.JPG"].xmp_create_date, rows["a/two.JPG"].xmp_modify_date) == (None, "2019-05-06T07:08:09Z")
    assert (rows["b/scan.tif"].has_exif, rows["b/scan.tif"].tiff_datetime) == (False, "2020:01:02 03:04:05")
    assert not rows["b/clip.mp4"].has_exif and rows["b/clip.mp4"].error is None


def test_listings(spark, tree):
    everything = {str(p) for p in tree.rglob("*") if p.is_file()}
    rows = listing.walk_folders(spark, str(tree)).collect()
    assert {r.path for r in rows} == everything
    assert all(r.file_size == os.stat(r.path).st_size for r in rows)
    assert {r.creation_date for r in rows} == {datetime.fromtimestamp(os.stat(p).st_ctime) for p in everything}
    shown = listing.scan_binary_files(spark, str(tree))
    assert {r.path for r in shown.collect()} == {p for p in everything if "/." not in p and os.path.getsize(p)}
    with pytest.raises(NotADirectoryError):
        listing.walk_folders(spark, str(tree / "none"))


def test_import_run_end_to_end(spark, tree, tmp_path):
    located = SnapshotTable(spark, str(tmp_path / "located"), schemas.LOCATED_FILES)
    archived = SnapshotTable(spark, str(tmp_path / "archived"), schemas.ARCHIVE_FILES)
    manifest = listing.walk_folders(spark, str(tree))
    fresh = inventory.append_new(located.read(), inventory.scan_inventory(manifest, ["jpg", "tif", "mp4"]))
    located.write(inventory.assign_ids(fresh, located.read()))
    assert sorted(r.id for r in located.read().collect()) == list(range(1, 8))
    again = inventory.append_counts(located.read(), inventory.scan_inventory(manifest, ["jpg", "tif", "mp4"])).first()
    assert (again.found, again.inserted, again.skipped) == (7, 0, 7)

    evidence = metadata.extract_metadata(manifest.withColumn("file_id", F.lit(0)))
    filters = settings.ImportFilters(min_file_size=1)
    run = settings.ImportSettings(("jpg", "tif", "mp4"), str(tmp_path / "archive"), filters)
    nothing = spark.createDataFrame([], "path string")
    counters = run_import(located, archived, manifest, evidence, run, str(tmp_path / "work"), as_of=timestamp_literal("2099-01-01 00:00:00"), added_at=now(), on_disk=nothing)
    total = counters.first()
    assert (total.copied, total.excluded, total.failed, total.missing, total.total) == (6, 1, 0, 0, 7)
    rows = {r.source_path: r for r in archived.read().collect()}
    one, other = (rows[str(tree / n)] for n in ("a/one.jpg", "b/one.jpg"))
    # GPS beats EXIF; the satellite date is 2020-01-03
    assert one.archive_path.endswith("/2020/01/03/one.jpg") and other.archive_path.endswith("/2020/01/03/one (1).jpg")
    for row in rows.values():
        assert open(row.archive_path, "rb").read() == open(row.source_path, "rb").read()
    assert one.gps_latitude == -(10 + 30 / 60 + 36 / 3600)
    assert {r.status for r in located.read().collect()} == {"imported", "excluded"}
    second = run_import(located, archived, manifest, evidence, run, str(tmp_path / "work2"), as_of=now(), added_at=now(), on_disk=nothing).first()
    assert (second.copied, second.excluded, second.total) == (0, 1, 1)


def test_hashes_and_duplicates(spark, tree):
    files = listing.walk_folders(spark, str(tree))
    hashes = {r.path: r.new_hash for r in contents.hash_files(files).collect()}
    assert hashes == {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in hashes}
    gone = spark.createDataFrame([(str(tree / "gone.jpg"),)], "path string")
    assert contents.hash_files(gone).first().new_hash is None


def test_hot_hash_is_spread(spark):
    """A hash shared by most files: its members meet their group in many tasks."""
    rows = spark.range(60_000).select(
        F.col("id").alias("position"), F.concat(F.lit("/p/"), F.col("id")).alias("path"), F.col("id").alias("file_size"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("file_hash"), F.lit(True).alias("documented"),
    )
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in off}
    try:
        for key, value in off.items():
            spark.conf.set(key, value)
        members = duplicates.duplicate_members(rows)
        sizes = members.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r["count"] for r in sizes) == 40_000
    assert max(r["count"] for r in sizes) < 20_000


def test_even_keys_are_shuffled_once(spark):
    """Without a hot key, each side of the members' join moves once and nothing is salted."""
    rows = spark.range(2_000).selectExpr("id as position", "concat('/p/', id) as path", "id as file_size", "cast(id % 900 as string) as file_hash", "true as documented")
    members = duplicates.duplicate_members(rows)
    assert members.count() == 2_000
    plan = members._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_listing_of_a_uri_is_complete(spark, tmp_path):
    (tmp_path / "_review_needed").mkdir()
    (tmp_path / "_review_needed" / ".x").write_bytes(b"x")
    (tmp_path / "empty").write_bytes(b"")
    os.symlink(tmp_path, tmp_path / "loop")
    os.utime(tmp_path / "empty", (0, 0))
    files = listing.walk_folders(spark, f"file://{tmp_path}", zone="Asia/Tokyo")
    rows = {r.path.removeprefix(f"file://{tmp_path}/"): r for r in files.collect()}
    assert {k: r.file_size for k, r in rows.items()} == {"_review_needed/.x": 1, "empty": 0}
    assert rows["empty"].modification_date == datetime(1970, 1, 1, 9)
    assert {r.new_hash for r in contents.hash_files(files).collect()} == {hashlib.sha256(b).hexdigest() for b in (b"x", b"")}


def test_only_missing_hashes_are_asked_for(spark):
    records = spark.createDataFrame([("/a", "h"), ("/b", ""), ("/c", None), ("/gone", None)], "file_path string, file_hash string")
    present = spark.createDataFrame([("/a",), ("/b",), ("/c",), ("/new",)], "path string")
    assert sorted(r.path for r in duplicates.missing_hashes(records, present).collect()) == ["/b", "/c"]
    catalog = records.withColumnRenamed("file_path", "archive_path")
    assert sorted(r.path for r in duplicates.unhashed_files(present, catalog).collect()) == ["/b", "/c", "/new"]


def test_vanished_file_with_hash_still_counts(spark):
    rows = [(1, "/a", 5, "h", "located"), (2, "/b", 5, "h", "located"), (3, "/c", 7, "", "located"), (4, "/d", 9, "h", "imported")]
    files = spark.createDataFrame(rows, "id long, file_path string, file_size long, file_hash string, status string")
    there = spark.createDataFrame([("/a",), ("/c",)], "path string")
    fresh = spark.createDataFrame([("/c", "k")], "file_path string, new_hash string")
    entries = duplicates.source_entries(files, fresh)
    group = duplicates.duplicate_groups(entries).first()
    assert (group.file_hash, group["count"], group.wasted_bytes) == ("h", 2, 5)
    assert tuple(duplicates.source_cache_counters(files, there, fresh).first()) == (1, 1, 1)


def test_audit_extension_filter_is_one_sided(spark):
    manifest = spark.createDataFrame([("/r/2020/01/02/a.jpg",), ("/r/2020/01/02/b.mp4",), ("/r/archive_database.db",)], "path string")
    catalog = spark.createDataFrame([("/r/2020/01/02/a.jpg",), ("/r/2020/01/02/b.mp4",)], "archive_path string")
    seen = audit.classify(inventory.archive_listing(manifest, ["JPG"]), catalog)
    assert {(r.path[-5:], r.section) for r in seen.collect()} == {("a.jpg", "matched"), ("b.mp4", "missing")}
    assert audit.classify(inventory.archive_listing(manifest), catalog).filter("section <> 'matched'").isEmpty()


CATALOG = "id long, archive_path string, date_uncertain int, user_corrected_date timestamp_ntz, corrected_at timestamp_ntz"
DAY = datetime(2019, 6, 15)
CATALOG_ROWS = [
    (1, "/r/_review_needed/a.jpg", 1, None, None), (2, "/r/2019/06/15/b.jpg", 0, DAY, DAY), (3, "/r/2020/01/01/c.jpg", 0, None, None),
    (4, "/r/_review_needed/gone.jpg", 1, None, None), (5, "/r/2019/06/15/a.jpg", 0, None, None),
]


def test_corrections(spark):
    catalog = spark.createDataFrame(CATALOG_ROWS, CATALOG)
    disk = catalog.filter("id <> 4").select(F.col("archive_path").alias("path"))
    asked = spark.createDataFrame([(1, 1, datetime(2001, 1, 1)), (2, 2, DAY), (3, 3, DAY), (4, 4, DAY), (5, 9, DAY), (6, 1, DAY)], schemas.CORRECTIONS)
    guarded = review.guard_corrections(asked, catalog, disk)
    served = review.serve_corrections(guarded, catalog.select("archive_path"), "/r")
    results = {r.seq: r for r in review.correction_results(guarded, served).collect()}
    assert [results[i].success for i in range(1, 7)] == [True, True, False, False, False, True]
    assert results[1].new_archive_path == "/r/2001/01/01/a.jpg"
    assert results[2].new_archive_path == "/r/2019/06/15/b (1).jpg"  # its own name is taken
    assert results[6].new_archive_path == "/r/2019/06/15/a (1).jpg"
    assert results[5].error == "No file with id 9." and results[4].error.startswith("File no longer exists on disk: ")
    assert results[3].error.startswith("File id 3 is not marked uncertain (date_uncertain=0) and has never")
    after = {r.id: r for r in review.apply_corrections(catalog, served, corrected_at=now()).collect()}
    assert (after[1].archive_path, after[1].date_uncertain, after[1].user_corrected_date) == ("/r/2019/06/15/a (1).jpg", 0, DAY)
    assert after[4].date_uncertain == 1 and after[3].corrected_at is None


def test_guard_marks_superseded_corrections(spark):
    catalog = spark.createDataFrame(CATALOG_ROWS, CATALOG)
    disk = catalog.filter("id <> 4").select(F.col("archive_path").alias("path"))
    asked = [(1, 1, DAY), (2, 1, DAY), (3, 1, DAY), (4, 2, DAY), (5, 3, DAY), (6, 3, DAY), (7, 4, DAY), (8, 4, DAY), (9, None, DAY), (10, None, DAY)]
    guarded = review.guard_corrections(spark.createDataFrame(asked, schemas.CORRECTIONS), catalog, disk)
    marked = review.mark_superseded(guarded)
    assert marked.columns == [*guarded.columns, "superseded"]
    assert {r.seq for r in marked.collect() if r.superseded} == {1, 2, 9}
    assert [r.superseded for r in marked.collect()].count(False) == 7


@pytest.mark.parametrize("empty", [False, True])
def test_guard_query_equals_its_sql(spark, tmp_path, empty):
    orders = "o_orderkey long, o_orderstatus string, o_orderpriority string, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"
    rows = [(k, "FOP"[k % 3], ["1-URGENT", "2-HIGH", "3-MEDIUM"][k // 7 % 3], k, 300000.0 + 1000 * k, DAY) for k in range(7, 300, 7)]
    buyers = [(k % 50 if k < 55 else None, k % 25, ["HOUSEHOLD", "MACHINERY"][k % 2]) for k in range(56)]
    spark.createDataFrame(rows[:0] if empty else rows, orders).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(buyers, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["correction_guard"](spark, str(tmp_path))
    assert got.columns == ["seq", "file_id", "error", "superseded"]
    db = duckdb.connect()
    for table in ("orders", "customer"):
        db.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert Counter(map(tuple, got.collect())) == Counter(db.execute(oracles.SQL["correction_guard"]).fetchall())
    assert empty != bool(got.filter("superseded and file_id is not null").count())


def corrected_one_by_one(paths_of, asked, taken, fails):
    """Outcome of each correction, served alone: its path, or nothing when the move fails."""
    taken, paths_of, found = set(taken), dict(paths_of), {}
    for seq, file_id, day in sorted(asked):
        old, number = PurePosixPath(paths_of[file_id]), 0
        new = wish = PurePosixPath("/r") / day.strftime("%Y/%m/%d") / old.name
        while str(new) in taken:
            number += 1
            new = wish.with_name(f"{wish.stem} ({number}){wish.suffix}")
        found[seq] = None if fails(seq) else str(new)
        if not fails(seq):
            taken = taken - {str(old)} | {str(new)}
            paths_of[file_id] = str(new)
    return found, paths_of


@pytest.mark.parametrize("seed, files, count, every_fails", [(1, 9, 16, None), (2, 25, 20, None), (3, 3, 9, 5)])
def test_corrections_end_as_if_they_came_one_by_one(spark, seed, files, count, every_fails):
    """Few names and days, so that corrections take names that others give up; or names of their own, and some moves fail."""
    rng = random.Random(seed)
    days = [datetime(2020, 1, d) for d in (1, 2, 3)]
    every = [f"/r/{place}/{name}" for place in ("_review_needed", "2020/01/01", "2020/01/02") for name in ("a.jpg", "b.jpg", "a (1).jpg", "a (2).jpg", "b (1) (1).jpg", "c")]
    every += [f"/r/_review_needed/{k}/a.jpg" for k in range(40)]
    paths_of = dict(enumerate(rng.sample(every, files) if every_fails is None else [f"/r/_review_needed/{k}.jpg" for k in range(files)]))
    asked = [(seq * 3, rng.randrange(files), rng.choice(days)) for seq in range(count)]
    fails = lambda seq: every_fails is not None and seq % every_fails == 0
    catalog = spark.createDataFrame([(k, p, 1, None, None) for k, p in paths_of.items()], CATALOG)
    taken = catalog.select("archive_path").union(spark.createDataFrame([("/r/2020/01/03/a.jpg",)], "archive_path string"))
    guarded = review.guard_corrections(spark.createDataFrame(asked, schemas.CORRECTIONS), catalog, catalog.select(F.col("archive_path").alias("path")))

    def move(plan):
        broken = F.col("seq") % every_fails == 0
        return plan.select("new_archive_path", F.when(broken, "failed").otherwise("moved").alias("outcome"), F.when(broken, "disk").alias("error"))

    served = review.serve_corrections(guarded, taken, "/r", move if every_fails else None).cache()
    want, last = corrected_one_by_one(paths_of, asked, [r.archive_path for r in taken.collect()], fails)
    got = review.correction_results(guarded, served).collect()
    assert {r.seq: r.new_archive_path for r in got} == want
    assert all(r.success == (r.error is None) == (want[r.seq] is not None) for r in got)
    assert {r.id: r.archive_path for r in review.apply_corrections(catalog, served, corrected_at=now()).collect()} == last


def test_moves_can_be_repeated(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"x")
    plan = spark.createDataFrame([(str(tmp_path / "x"), str(tmp_path / "d" / "y")), (str(tmp_path / "no"), str(tmp_path / "z"))], "archive_path string, new_archive_path string")
    for _ in range(2):
        assert sorted(r.outcome for r in contents.move_files(plan).collect()) == ["failed", "moved"]
    assert (tmp_path / "d" / "y").read_bytes() == b"x"


def test_nothing_is_overwritten(spark, tmp_path):
    for name, data in (("a", b"one"), ("b", b"two"), ("c", b"same"), ("d", b"same")):
        (tmp_path / name).write_bytes(data)
    rows = [(str(tmp_path / "a"), str(tmp_path / "b")), (str(tmp_path / "c"), str(tmp_path / "d"))]
    plan = spark.createDataFrame(rows, "source_path string, archive_path string")
    for _ in range(2):
        assert {r.archive_path[-1]: r.outcome for r in contents.copy_files(plan).collect()} == {"b": "failed", "d": "copied"}
    moves = plan.selectExpr("source_path as archive_path", "archive_path as new_archive_path")
    assert {r.new_archive_path[-1]: r.outcome for r in contents.move_files(moves).collect()} == {"b": "failed", "d": "moved"}
    left = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert left == {"a": b"one", "b": b"two", "d": b"same"}


def test_correction_batch_ends_between_move_and_write(spark, tmp_path, monkeypatch):
    """Run again, the batch finds its plan and outcomes; a failed move is a refusal and changes nothing."""
    root = tmp_path / "r"
    (root / "_review_needed").mkdir(parents=True)
    for name in ("a", "b"):
        (root / "_review_needed" / f"{name}.jpg").write_bytes(name.encode())
    rows = [(k, f"{root}/_review_needed/{name}.jpg", 1, None, None) for k, name in ((1, "a"), (2, "b"))]
    table = ChangeTable(spark, str(tmp_path / "t"), schemas.ARCHIVE_FILES)
    table.base.write(spark.createDataFrame(rows, CATALOG))
    spark.createDataFrame([(1, 1, DAY), (2, 2, DAY)], schemas.CORRECTIONS).write.parquet(str(tmp_path / "asked"))

    def move(plan):
        broken = plan.withColumn("archive_path", F.when(F.col("file_id") == 2, F.concat("archive_path", F.lit(".gone"))).otherwise(F.col("archive_path")))
        return contents.move_files(broken)

    def run(checkpoint):
        stream = spark.readStream.schema(schemas.CORRECTIONS).parquet(str(tmp_path / "asked"))
        tables.stream_corrections(
            stream, table, str(tmp_path / checkpoint), str(tmp_path / "results"), archive_root=str(root), corrected_at=now(),
            listing=lambda: listing.walk_folders(spark, str(root)), move=move,
        ).awaitTermination()

    def lost(rows, batch):
        raise RuntimeError("lost before the catalog is written")

    with monkeypatch.context() as patch:
        patch.setattr(table, "write", lost)
        with pytest.raises(Exception, match="lost before"):
            run("c1")
    assert (root / "2019/06/15/a.jpg").exists() and table.last_batch() == -1
    run("c2")
    after = {r.id: (r.archive_path, r.date_uncertain) for r in table.read().collect()}
    assert after == {1: (f"{root}/2019/06/15/a.jpg", 0), 2: (f"{root}/_review_needed/b.jpg", 1)}
    results = {r.seq: r for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert results[1].success and not results[2].success and results[2].error and results[2].new_archive_path is None


def test_enrichment_of_odd_rows(spark):
    files = spark.createDataFrame([(1, "/d/a.jpg"), (2, "/d/b.jpg")], "file_id long, path string")
    sidecars = spark.createDataFrame(
        [("/d/a.jpg.json", '{"photoTakenTime": {"timestamp": "1700000000000"}}', None), ("/d/b.jpg.json", '{"photoTakenTime": {"timestamp": "86400"}}', None)],
        "path string, content string, date_time_original string",
    )
    assert [(r.file_id, r.date) for r in enrichment.sidecar_signals(files, sidecars).collect()] == [(2, datetime(1970, 1, 2))]
    long = "9" * 25
    rows = [(1, f"/d/IMG_{long}1.jpg", DAY), (2, f"/d/IMG_{long}2.jpg", None), (3, f"/d/IMG_{long}9.jpg", DAY), (4, "/d/IMG_007.jpg", DAY), (5, "/d/IMG_8.jpg", None)]
    numbered = spark.createDataFrame(rows, "file_id long, path string, date timestamp_ntz")
    assert {r.file_id for r in enrichment.sequence_signals(numbered).collect()} == {2, 5}
    twins = spark.createDataFrame([("/n/a", "h"), ("/n/b", "h"), ("/n/c", "k"), ("/n/d", None), ("/n/e", None)], "path string, file_hash string")
    held = spark.createDataFrame([("k",)], "file_hash string")
    assert sorted(r.path for r in enrichment.skip_identical(twins, held).collect()) == ["/n/a", "/n/d", "/n/e"]


def test_sequence_neighbors_by_growing_windows(spark):
    rng = random.Random(4)
    rows = [(k, f"/d{k % 2}/{'IMG_' if k % 3 else 'P'}{rng.choice(['', '0', '12' * 7])}{rng.randint(0, 300)}.jpg") for k in range(900)]
    rows += [(k, f"/d0/IMG_{k * 700_000}.jpg") for k in range(900, 960)]
    rows = [(*row, None if rng.random() < 0.6 else DAY + timedelta(hours=rng.randint(0, 40))) for row in rows]
    found = enrichment.sequence_signals(spark.createDataFrame(rows, "file_id long, path string, date timestamp_ntz").repartition(3))
    dates, parts = {}, {}
    for file_id, path, date in rows:
        stem = path[: -len(".jpg")]
        number = stem[len(stem.rstrip("0123456789")) :]
        parts[file_id] = series, number = stem[: -len(number)], int(number)
        if date:
            held = dates.setdefault(series, {})
            held[number] = min(held.get(number, date), date)
    want = {}
    for file_id, _, date in rows:
        series, number = parts[file_id]
        before = max((n for n in dates[series] if n < number), default=None)
        after = min((n for n in dates[series] if n > number), default=None)
        if date is None and before is not None and after is not None and dates[series][before].date() == dates[series][after].date():
            want[file_id] = dates[series][before]
    assert {r.file_id: r.date for r in found.collect()} == want and len(want) > 50
    # A frame that ends with its partition is summed up anew for every row.
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_fix_plan_gives_every_move_its_own_target(spark):
    rows = [(k, f"/r/2020/01/0{k}/x.jpg", DAY, None) for k in (1, 2, 3)] + [(4, "/r/2019/06/15/x.jpg", DAY, None), (5, "/r/2019/06/15/gone.jpg", DAY, None)]
    catalog = spark.createDataFrame(rows, "id long, archive_path string, date_taken timestamp_ntz, user_corrected_date timestamp_ntz")
    disk = catalog.filter("id <> 5").select(F.col("archive_path").alias("path")).union(spark.createDataFrame([("/r/new.jpg",)], "path string"))
    plan = enrichment.fix_plan(disk, catalog, "/r").collect()
    moves = {r.path: r.target for r in plan if r.action == "move"}
    assert moves == {f"/r/2020/01/0{k}/x.jpg": f"/r/2019/06/15/x ({k}).jpg" for k in (1, 2, 3)}
    assert sorted((r.action, r.path) for r in plan if r.action != "move") == [("add_to_catalog", "/r/new.jpg"), ("drop_from_catalog", "/r/2019/06/15/gone.jpg")]


def test_inventory_stream(spark, tmp_path):
    source = str(tmp_path / "manifests")
    table = AppendTable(spark, str(tmp_path / "t"), schemas.LOCATED_FILES)
    for round_ in (["/m/a.jpg", "/m/b.txt"], ["/m/a.jpg", "/m/c.JPG"]):
        rows = spark.createDataFrame([(p, 1, DAY, DAY) for p in round_], schemas.MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.MANIFEST).parquet(source)
        tables.stream_inventory(stream, table, str(tmp_path / "c"), ["jpg"]).awaitTermination()
    assert {(r.id, r.file_path) for r in table.read().collect()} == {(1, "/m/a.jpg"), (2, "/m/c.JPG")}
    assert table.batches() == [0, 1]
    assert [spark.read.parquet(f"{table.root}/batch={k}").count() for k in (0, 1)] == [1, 1]  # a batch writes its own rows


def test_inventory_stream_reads_its_batch_only(spark, tmp_path, monkeypatch):
    """Known paths come from the table at the first start and from state later: the table is not read again."""
    table, source = AppendTable(spark, str(tmp_path / "t"), schemas.LOCATED_FILES), str(tmp_path / "manifests")
    table.write(spark.createDataFrame([(7, "/m/a.jpg")], "id long, file_path string"), 0)
    spark.createDataFrame([("/m/none.jpg", 1, DAY, DAY)], schemas.MANIFEST).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schemas.MANIFEST).parquet(source)
        tables.stream_inventory(stream, table, str(tmp_path / "c"), ["jpg"]).awaitTermination()
        return sorted((r.id, r.file_path) for r in table._rows(covering(table.parts())).collect())

    assert run() == [(7, "/m/a.jpg"), (8, "/m/none.jpg")]
    rows = [("/m/a.jpg", 1, DAY, DAY), ("/m/b.jpg", 1, DAY, DAY), ("/m/b.jpg", 2, DAY, DAY), ("/m/none.jpg", 1, DAY, DAY)]
    spark.createDataFrame(rows, schemas.MANIFEST).write.mode("append").parquet(source)
    monkeypatch.setattr(table, "read", lambda before=None: spark.createDataFrame([], schemas.LOCATED_FILES))
    assert run() == [(7, "/m/a.jpg"), (8, "/m/none.jpg"), (9, "/m/b.jpg")] and table.batches() == [0, 1, 2]


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_merges_keep_few_parts(fan):
    parts, most, rewritten = set(), 0, 0
    for batch in range(1000):
        parts.add(Part(batch, batch, 0))
        while run := due_merge(parts, fan):
            parts &= set(covering(parts))
            parts.add(Part(run[0].first, run[-1].last, run[0].level + 1))
            rewritten += run[-1].last - run[0].first + 1
        most = max(most, len(covering(parts)))
    ranges = covering(parts)
    assert [n for p in ranges for n in range(p.first, p.last + 1)] == list(range(1000))
    levels = math.ceil(math.log(1000, fan))
    assert most <= fan * levels and rewritten <= 1000 * levels
    assert all(Part.named(p.folder) == p for p in parts)


def test_append_table_merges_its_parts(spark, tmp_path):
    table = AppendTable(spark, str(tmp_path / "t"), "id long", fan=3)
    for batch in range(10):
        table.write(spark.range(batch * 2, batch * 2 + 2), batch)
        assert table.highest("id") == batch * 2 + 1
    assert sorted(r.id for r in table.read().collect()) == list(range(20)) and table.batches() == list(range(10))
    assert [p.level for p in covering(table.parts())] == [2, 0]
    assert len(list((tmp_path / "t").iterdir())) < 10


def test_fold_rewrites_touched_buckets_only(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "id long, v long", buckets=8, fold_after=4)
    table.base.write(spark.range(100).selectExpr("id", "0L as v"))
    before = set(table.base.folders())
    state = dict.fromkeys(range(100), 0)
    for batch in range(12):
        table.write(spark.createDataFrame([(5, batch), (1000, batch)], "id long, v long"), batch)
        state |= {5: batch, 1000: batch}
        assert len(table.base.folders()) <= 8 and len(table.changes.parts()) <= 2 * 4 + 1
        assert batch % 4 or {r.id: r.v for r in table.read().collect()} == state
    assert table.base.version() > 2 and len(before & set(table.base.folders())) >= 6
    assert {r.id: r.v for r in table.read().collect()} == state and table.last_batch() == 11


def test_correction_stream_skips_finished_batches(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), schemas.ARCHIVE_FILES)
    table.base.write(spark.createDataFrame(CATALOG_ROWS, CATALOG))
    source = str(tmp_path / "asked")
    spark.createDataFrame([(1, 1, DAY)], schemas.CORRECTIONS).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(schemas.CORRECTIONS).parquet(source)
        tables.stream_corrections(
            stream, table, str(tmp_path / checkpoint), str(tmp_path / "results"), archive_root="/r", corrected_at=now()
        ).awaitTermination()
        return table.last_batch(), {r.id: r.archive_path for r in table.read().collect()}[1]

    assert run("c1") == (0, "/r/2019/06/15/a (1).jpg")
    assert run("c2") == (0, "/r/2019/06/15/a (1).jpg")  # the same batch again, as after a lost commit
    assert table.changes.read().count() == 1 and table.read().count() == len(CATALOG_ROWS)
    before = sorted(map(repr, table.read().collect()))
    assert table.fold() == 2 and sorted(map(repr, table.read().collect())) == before
    assert spark.read.parquet(str(tmp_path / "results")).first().success


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_running_total(spark, bits):
    rows = [("k" if i % 3 else "l", i * 5, i % 4) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r.k, r.p): r.t for r in running_total(frame, ["k"], "p", "v", "t", bits).collect()}
    assert got == {(k, p): sum(v for k2, p2, v in rows if k2 == k and p2 < p) for k, p, _ in rows}


def test_report(spark, tmp_path):
    write_report({"summary": spark.range(1), "files": spark.range(3)}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "files")).count() == 3


def test_whole_reports(spark, tmp_path):
    undocumented = spark.createDataFrame(
        [(f"/r/2020/01/0{k}/{chr(34)}é\n{k}.jpg", k, k % 2 == 0, "2020/01/01" if k % 2 else None, "2020/01/02" if k % 2 else None) for k in (3, 1, 2)],
        "path string, file_size long, correctly_placed boolean, expected_folder string, actual_folder string",
    )
    missing = spark.createDataFrame([(1, "/r/b", None), (2, "/r/a", DAY)], "id long, archive_path string, user_corrected_date timestamp_ntz")
    misplaced = spark.createDataFrame([], "archive_path string, actual_folder string")
    summary = spark.createDataFrame([(3, False)], "undocumented_count long, in_sync boolean")
    target = reports.audit_document(str(tmp_path / "out" / "audit.json"), spark, "/r", "2024-06-15T12:00:00", summary, undocumented, missing, misplaced)
    with open(target) as source:
        report = json.load(source)
    assert list(report) == ["audit_timestamp", "archive_root", "summary", "undocumented_files", "missing_files", "misplaced_files"]
    assert report["summary"] == {"undocumented_count": 3, "in_sync": False} and report["misplaced_files"] == []
    assert [sorted(e) for e in report["undocumented_files"]] == [
        sorted(undocumented.columns), ["correctly_placed", "file_size", "path"], sorted(undocumented.columns)
    ]
    assert [e["archive_path"] for e in report["missing_files"]] == ["/r/a", "/r/b"] and report["missing_files"][1]["user_corrected_date"] is None
    assert [e["file_size"] for e in report["undocumented_files"]] == [1, 2, 3]

    files = [("h1", f"/f/{k:04}", 5, k % 2 == 0) for k in range(700)] + [("h2", "/g/a", 9000, True), ("h2", "/g/b", 9000, False), ("h3", "/z", 1, True)]
    entries = spark.createDataFrame([(p, h, p, s, d) for h, p, s, d in files], "position string, file_hash string, path string, file_size long, documented boolean")
    groups = duplicates.duplicate_groups(entries)
    members = duplicates.duplicate_members(entries).join(groups.select("file_hash", "wasted_bytes", "first_path"), "file_hash")
    target = reports.duplicate_document(str(tmp_path / "dup.json"), "archive", "now", duplicates.duplicate_summary(entries), groups, members)
    with open(target) as source:
        report = json.load(source)
    assert report["mode"] == "archive" and report["summary"]["duplicate_files"] == 702
    assert [(g["file_hash"], g["file_size"], g["count"]) for g in report["duplicate_groups"]] == [("h2", 9000, 2), ("h1", 5, 700)]
    assert [f["path"] for f in report["duplicate_groups"][1]["files"]] == [f"/f/{k:04}" for k in range(700)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["dup.json", "out"]


def test_bucketed_sides_meet_without_a_shuffle(spark):
    rows = [(k, f"/archive/2020/01/{k % 9:02}/f{k}.jpg") for k in range(3000)]
    catalog = spark.createDataFrame(rows, "id long, archive_path string").withColumns(
        {"date_taken": F.lit(DAY), "user_corrected_date": F.lit(None).cast("timestamp_ntz"), "date_uncertain": F.lit(1), "date_added": F.lit(DAY)}
    )
    disk = spark.createDataFrame(rows[500:] + [(0, "/archive/new.jpg")], "n long, path string").drop("n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held, found = bucketed.write_bucketed(catalog, "held_files", "archive_path", 4), bucketed.write_bucketed(disk, "found_files", "path", 4)
        queries = [lambda c, d: audit.classify(d, c), lambda c, d: audit.missing_files(d, c), lambda c, d: audit.misplaced_files(d, c, "/archive"), lambda c, d: review.with_location(c, d, "/archive")]
        for build in queries:
            plan = build(held, found)
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(repr, plan.collect())) == sorted(map(repr, build(catalog, disk).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("held_files", "found_files"):
            spark.sql(f"drop table if exists {name}")


def test_copies_and_moves_by_uri(spark, tmp_path):
    """URIs go through pyarrow's file systems: streamed, never over another file, repeatable."""
    for name, data in (("a", b"one" * 3_000_000), ("b", b"two"), ("c", b"same"), ("d", b"same")):
        (tmp_path / name).write_bytes(data)
    base = f"file://{tmp_path}"
    rows = [(f"{base}/a", f"{base}/x/y/a2"), (f"{base}/a", f"{base}/b"), (f"{base}/c", f"{base}/d"), (f"{base}/none", f"{base}/e")]
    plan = spark.createDataFrame(rows, "source_path string, archive_path string")
    for _ in range(2):
        got = {r.archive_path.rsplit("/", 1)[1]: r for r in contents.copy_files(plan).collect()}
        assert {k: r.outcome for k, r in got.items()} == {"a2": "copied", "b": "failed", "d": "copied", "e": "failed"}
        assert got["b"].error and got["e"].error
    moved = plan.selectExpr("source_path as archive_path", "concat(archive_path, '.moved') as new_archive_path")
    moves = moved.filter("archive_path like '%/c' or archive_path like '%/none'")
    for _ in range(2):
        assert sorted(r.outcome for r in contents.move_files(moves).collect()) == ["failed", "moved"]
    assert (tmp_path / "x/y/a2").read_bytes() == (tmp_path / "a").read_bytes()
    assert (tmp_path / "d.moved").read_bytes() == b"same" and not (tmp_path / "c").exists()
    assert not [p for p in tmp_path.rglob("*") if p.name.endswith(".partial")]


def test_hot_label_is_spread(spark):
    catalog = spark.range(3000).selectExpr("id", "concat('/f', id) as archive_path")
    labels = spark.createDataFrame([(1, "beach", "place"), (2, "cat", "animal"), (3, "beach", "scene")], "id long, label_name string, category string")
    carried = spark.range(3000).selectExpr("id as file_id", "case when id % 3 < 2 then 1L else 2L end as label_id", "'model' as source")
    found = enrichment.label_search(catalog, labels, carried, "beach")
    sizes = [len(part) for part in found.rdd.glom().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 1000
