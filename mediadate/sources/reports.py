"""Whole reports: one JSON document of a header and ordered sections of any length.

Sections are sorted by ranges over the cluster and written as lines; one task then streams the lines
into the document, chunk by chunk. Neither the driver nor that task holds a section.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediadate.operators.lineage import settle_table, shared_place
from mediadate.settings import ARCHIVE_ROOT_FIELD, MISPLACED_COLUMNS

ENTRY, REST = "E", "R"
CHUNK = 4 << 20


def number_rows(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add the place of every row in an order, from 0, by ranges: the driver gets nothing, and one row
    per range, as many as there are shuffle partitions, is summed in one place."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = settle_table(dealt.withColumn("_local", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_local", 33))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + local)
    return numbered.drop("_local", "_part", "_start")


def json_line(*columns: str) -> Column:
    """The columns as a JSON object; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def audit_sections(undocumented: DataFrame, missing: DataFrame, misplaced: DataFrame) -> dict[str, DataFrame]:
    """The sections of an audit report as ``path, line, start``, each to be ordered by path.

    An undocumented file names folders only if it lies in a wrong one.
    """
    base = [c for c in undocumented.columns if c not in MISPLACED_COLUMNS]
    line = F.when(F.col("correctly_placed"), json_line(*base)).otherwise(json_line(*undocumented.columns))
    whole = {
        "undocumented_files": undocumented.select("path", line.alias("line")),
        "missing_files": missing.select(F.col("archive_path").alias("path"), json_line(*missing.columns).alias("line")),
        "misplaced_files": misplaced.select(F.col("archive_path").alias("path"), json_line(*misplaced.columns).alias("line")),
    }
    return {name: rows.withColumn("start", F.lit(True)) for name, rows in whole.items()}


def duplicate_section(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with their files as ``wasted_bytes, first_path, step, path, line, start``: a head, a line
    for every file and an end, so that a group of any size is many lines; most wasteful group first."""
    head = F.concat(F.regexp_replace(json_line("file_hash", "file_size", "count"), r"\}\z", ""), F.lit(',"files":['))
    none = F.lit(None).cast("string").alias("path")
    order = ["wasted_bytes", "first_path"]
    opened = groups.select(*order, F.lit(0).alias("step"), none, head.alias("line"), F.lit(True).alias("start"))
    closed = groups.select(*order, F.lit(2).alias("step"), none, F.lit("]}").alias("line"), F.lit(False).alias("start"))
    comma = F.when(F.col("path") == F.col("first_path"), "").otherwise(",")
    files = members.select(*order, F.lit(1).alias("step"), "path", F.concat(comma, json_line("path", "documented")).alias("line"), F.lit(False).alias("start"))
    return opened.unionByName(files).unionByName(closed)


def write_document(target: str, header: dict[str, object], summary: DataFrame, sections: dict[str, tuple[DataFrame, list[Column]]]) -> str:
    """Write ``header``, the one row of ``summary`` and the sections (``line, start`` and an order) as one JSON document.

    Lines are entries (``start``) or go on with the one before. The document gets its name when it is whole.
    """
    spark = summary.sparkSession
    places = {}
    for name, (rows, order) in sections.items():
        places[name] = shared_place(spark)
        marked = rows.withColumn("_marked", F.concat(F.when(F.col("start"), ENTRY).otherwise(REST), "line"))
        marked.repartitionByRange(*order).sortWithinPartitions(*order).select("_marked").write.text(places[name])
    told = summary.select(json_line(*summary.columns)).first()[0]
    head = "{" + "".join(f"{json.dumps(key)}: {json.dumps(value)},\n" for key, value in header.items()) + f'"summary": {told}'
    part = f"{target}.{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sum(batch.num_rows for batch in batches)
        if rows:
            system, path = _file_system(part)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                out.write(head.encode())
                for name, place in places.items():
                    out.write(f',\n{json.dumps(name)}: ['.encode())
                    first = True
                    for line in _lines(place):
                        if line[:1] == ENTRY.encode():
                            out.write(b"\n" if first else b",\n")
                            first = False
                        out.write(line[1:])
                    out.write(b"]")
                out.write(b"}\n")
            yield pa.RecordBatch.from_pydict({"path": [part]})

    spark.range(1).repartition(1).mapInArrow(work, "path string").collect()
    system, path = _file_system(part)
    system.move(path, _file_system(target)[1])
    return target


def _file_system(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if ":/" in place else (fs.LocalFileSystem(), place)


def _lines(place: str) -> Iterator[bytes]:
    """The lines of a folder's part files, in the order of their names."""
    system, path = _file_system(place)
    found = system.get_file_info(fs.FileSelector(path))
    for info in sorted(found, key=lambda i: i.path):
        if info.base_name.startswith("part-"):
            with system.open_input_stream(info.path) as source:
                rest = b""
                while chunk := source.read(CHUNK):
                    *whole, rest = (rest + chunk).split(b"\n")
                    yield from whole


def audit_document(
    target: str, spark: SparkSession, archive_root: str, stamp: str, summary: DataFrame, undocumented: DataFrame, missing: DataFrame, misplaced: DataFrame
) -> str:
    """Write an audit report: time, root, summary, then the three sections by path."""
    header = {"audit_timestamp": stamp, ARCHIVE_ROOT_FIELD: archive_root}
    sections = audit_sections(undocumented, missing, misplaced)
    return write_document(target, header, summary, {name: (rows, [F.col("path")]) for name, rows in sections.items()})


def duplicate_document(target: str, mode: str, stamp: str, summary: DataFrame, groups: DataFrame, members: DataFrame) -> str:
    """Write a duplicate report: time, mode, summary, then the groups with their files, most wasteful first."""
    order = [F.desc("wasted_bytes"), F.asc("first_path"), F.asc("step"), F.asc("path")]
    return write_document(target, {"scan_timestamp": stamp, "mode": mode}, summary, {"duplicate_groups": (duplicate_section(groups, members), order)})
