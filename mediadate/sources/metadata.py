"""One distributed pass over file bytes: the few tags the date signals need."""

from __future__ import annotations

import mmap
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediadate import schemas

# Tag numbers, field widths and XMP names of the file formats.
IFD0_TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "tiff_datetime"}
EXIF_TAGS = {
    0x9003: "date_time_original", 0x9004: "date_time_digitized", 0x829D: "f_number",
    0x8827: "iso_speed", 0x920A: "focal_length",
}
GPS_TAGS = {1: "gps_lat_ref", 2: "gps_lat", 3: "gps_lon_ref", 4: "gps_lon", 7: "gps_time_stamp", 29: "gps_date_stamp"}
EXIF_POINTER, GPS_POINTER, XMP_TAG = 0x8769, 0x8825, 700
FIELD_FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "s", 8: "h", 9: "i", 10: "ii"}
EXIF_HEADER, XMP_HEADER = b"Exif\x00\x00", b"http://ns.adobe.com/xap/1.0/\x00"
XMP_ELEMENTS = {
    "xmp_create_date": "{http://ns.adobe.com/xap/1.0/}CreateDate",
    "photoshop_date_created": "{http://ns.adobe.com/photoshop/1.0/}DateCreated",
    "xmp_modify_date": "{http://ns.adobe.com/xap/1.0/}ModifyDate",
}
COLUMNS = [part.split()[0] for part in schemas.EVIDENCE_TAGS.replace("\n", " ").split(",")]
TEXT_TAGS = ("date_time_original", "date_time_digitized", "tiff_datetime", "gps_date_stamp", "gps_lat_ref", "gps_lon_ref")
ARRAY_TAGS = ("gps_lat", "gps_lon", "gps_time_stamp")


def _directory(block, offset: int, order: str) -> dict[int, object]:
    """Tag values of one image file directory."""
    tags = {}
    (count,) = struct.unpack_from(order + "H", block, offset)
    for entry in range(offset + 2, offset + 2 + 12 * count, 12):
        tag, kind, n = struct.unpack_from(order + "HHI", block, entry)
        form = FIELD_FORMATS.get(kind)
        if form is None:
            continue
        width = struct.calcsize("=" + form) * n
        at = entry + 8 if width <= 4 else struct.unpack_from(order + "I", block, entry + 8)[0]
        raw = bytes(block[at : at + width])
        if len(raw) < width:
            continue
        if form == "s":
            tags[tag] = raw.removesuffix(b"\x00").decode("latin-1") if kind == 2 else raw
            continue
        numbers = struct.unpack(order + form * n, raw)
        if len(form) == 2:
            numbers = tuple(a / b if b else float("nan") for a, b in zip(numbers[::2], numbers[1::2]))
        tags[tag] = numbers[0] if n == 1 else numbers
    return tags


def _tiff_tags(block) -> dict[str, object]:
    order = {b"II": "<", b"MM": ">"}[bytes(block[:2])]
    main = _directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
    found = {name: main.get(tag) for tag, name in IFD0_TAGS.items()}
    nested = dict(main)
    for pointer, names in ((EXIF_POINTER, EXIF_TAGS), (GPS_POINTER, GPS_TAGS)):
        inner = _directory(block, main[pointer], order) if pointer in main else {}
        if pointer == EXIF_POINTER:
            nested.update(inner)
            inner = nested
        found.update({name: inner.get(tag) for tag, name in names.items()})
    found["has_exif"] = bool(main)
    found["_xmp"] = main.get(XMP_TAG)
    return found


def _jpeg_tags(block) -> dict[str, object]:
    found, at = {}, 2
    while at + 4 <= len(block) and block[at] == 0xFF and block[at + 1] != 0xDA:
        size = struct.unpack_from(">H", block, at + 2)[0]
        if block[at + 1] == 0xE1:
            body = bytes(block[at + 4 : at + 2 + size])
            if body.startswith(EXIF_HEADER) and "has_exif" not in found:
                found.update(_tiff_tags(body[len(EXIF_HEADER) :]), _xmp=found.get("_xmp"))
            elif body.startswith(XMP_HEADER):
                found["_xmp"] = body[len(XMP_HEADER) :]
        at += 2 + size
    return found


def xmp_elements(packet: bytes | str) -> dict[str, str | None]:
    """Text of the three date elements, found by namespace; attributes do not count."""
    root = ET.fromstring(packet)
    found = {name: root.find(f".//{tag}") for name, tag in XMP_ELEMENTS.items()}
    return {name: None if element is None else element.text for name, element in found.items()}


def _number_text(value, before="", after="") -> str | None:
    if value is None:
        return None
    try:
        return f"{before}{float(value):.1f}{after}"
    except (TypeError, ValueError):
        return str(value)


def tags_of(block) -> dict[str, object]:
    """Typed evidence of one file from its bytes."""
    if bytes(block[:2]) == b"\xff\xd8":
        found = _jpeg_tags(block)
    elif bytes(block[:4]) in (b"II*\x00", b"MM\x00*"):
        # Camera tags are looked for in JPEG data only; a TIFF speaks through its own date tag.
        tags = _tiff_tags(block)
        found = {"tiff_datetime": tags["tiff_datetime"], "_xmp": tags["_xmp"]}
    else:
        return {}
    row = {name: found.get(name) for name in COLUMNS}
    for name in TEXT_TAGS:
        row[name] = row[name] if isinstance(row[name], str) else None
    for name in ARRAY_TAGS:
        value = row[name]
        row[name] = [float(v) for v in value] if isinstance(value, tuple) else None
    for name in ("make", "model", "iso_speed"):
        row[name] = None if row[name] is None else str(row[name])
    row["aperture"] = _number_text(found.get("f_number"), before="f/")
    row["focal_length_mm"] = _number_text(found.get("focal_length"), after="mm")
    if found.get("_xmp"):
        try:
            row.update(xmp_elements(found["_xmp"]))
        except (ET.ParseError, UnicodeDecodeError):
            pass
    return row


def _read(path: str, content: bytes | None) -> dict[str, object]:
    if content is not None:
        return tags_of(content)
    with open(path, "rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as block:
        return tags_of(block)


def extract_metadata(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """Evidence table of files given by ``path`` and, optionally, their bytes in ``content``.

    Without ``content`` a task maps the file into memory and touches only the pages its headers lie
    on. A file that cannot be read keeps its row: no tags, the trouble in ``error``.
    """
    with_bytes = "content" in files.columns

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            contents = batch["content"] if with_bytes else [None] * len(batch)
            for path, content in zip(batch["path"], contents):
                row, error = {}, None
                try:
                    row = _read(path, content)
                except Exception as trouble:  # one bad file must not fail the job
                    error = f"{type(trouble).__name__}: {trouble}"
                row = {name: row.get(name) for name in COLUMNS}
                rows.append({**row, "has_exif": bool(row["has_exif"]), "error": error})
            yield pd.concat(
                [batch[[id_column, "path"]].reset_index(drop=True), pd.DataFrame(rows, columns=[*COLUMNS, "error"]).astype(object)], axis=1
            )

    columns = [id_column, "path"] + (["content"] if with_bytes else [])
    kind = dict(files.dtypes)[id_column]
    schema = f"{id_column} {kind}, path string, {schemas.EVIDENCE_TAGS}, error string"
    return files.select(*columns).mapInPandas(extract, schema)


def xmp_fields(packet: Column) -> Column:
    """Struct of the three date elements of an XMP packet held as text; nulls for what is no XML."""

    def read(text):
        try:
            return xmp_elements(text) if text else {}
        except ET.ParseError:
            return {}

    def fields(packets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p) for p in packets], columns=list(XMP_ELEMENTS)).astype(object)

    kind = T.StructType([T.StructField(name, T.StringType()) for name in XMP_ELEMENTS])
    return F.pandas_udf(fields, kind)(packet)
