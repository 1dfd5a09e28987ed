"""Writing pages as WARC archives and reading them back by byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range of an archive, looks for
the gzip magic from its start, takes the first place whose member decodes to a WARC header for a
record, and goes on member by member. It owns the records that start inside its range and reads
the last one beyond the end. A magic inside compressed data fails the decoding and is passed over,
and so is a damaged member; ``read_whole`` compares the records read with those written and fails if
one is missing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import file_system, partitions, settle, shared_folder

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
STEP = 1 << 18
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_type string, page string, refers string, uri string, payload_bytes long, payload_digest string, intact boolean, path string, offset long"
FIELDS = [part.split(" ")[0] for part in RECORD.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack_record(page: object, uri: str | None, payload: bytes, refers: object = None) -> bytes:
    """One gzip member; a revisit has the HTTP head only, whose length names the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    record = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write one archive per task to the shared folder; result: path, bytes, records.

    Urls and payloads of any length are written whole, one record in memory at a time. Repeated rows are
    records of their own; an empty table gives no archive; other columns are not read.
    ``pages`` has page_id, url, html (null: empty payload). Of equal payloads of ``least_bytes`` or
    more, the record with the smallest page_id is the response and others revisit it; rows that
    repeat that page_id and payload are responses, too, and so are rows with a null page_id. Only
    page_id and digest meet others, pre-aggregated per digest. An archive's name is new for each
    attempt of a task, and the result names those of the attempts that counted.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    narrow = settle(rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest"))
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisits = narrow.join(firsts, "digest").where("page_id <> first").distinct()
    joined = rows.join(settle(revisits), ["page_id", "digest"], "left").select("page_id", "url", "html", "first")

    def write(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        path = f"{path}/{uuid.uuid4().hex}.warc.gz"
        records, size = 0, 0
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for page, uri, text, first in zip(*(column.to_pylist() for column in batch.columns)):
                    member = pack_record(page, uri, text.encode("utf-8", "surrogatepass"), first)
                    out.write(member)
                    records, size = records + 1, size + len(member)
        if records:
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{path.rsplit('/', 1)[1]}", "bytes": size, "records": records}])

    return settle(joined.mapInArrow(write, "path string, bytes long, records long"))


class RangeReader:
    """The records that start in [start, end) of an archive."""

    def __init__(self, source, start: int, end: int):
        self.source, self.start, self.end, self.size = source, start, end, source.size()

    def _at(self, place: int, count: int) -> bytes:
        return self.source.read_at(min(count, max(0, self.size - place)), place)

    def _magic_from(self, place: int) -> int | None:
        while place < min(self.end, self.size):
            window = self._at(place, STEP + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found >= 0:
                return place + found if place + found < self.end else None
            place += STEP
        return None

    def _decode(self, place: int) -> tuple[bytes, int] | None:
        """A whole member and the place after it; none if this is no member with a WARC header."""
        unpacker, parts, read, size = zlib.decompressobj(31), [], place, 0
        checked = False
        try:
            while not unpacker.eof:
                chunk = self._at(read, STEP)
                if not chunk:
                    return None
                read += len(chunk)
                parts.append(unpacker.decompress(chunk))
                size += len(parts[-1])
                if not checked and (size >= 7 or unpacker.eof):
                    parts = [b"".join(parts)]
                    if not parts[0].startswith(b"WARC/1."):
                        return None
                    checked = True
        except zlib.error:
            return None
        record = b"".join(parts)
        return (record, read - len(unpacker.unused_data)) if b"\r\n\r\n" in record else None

    def __iter__(self):
        place = self.start
        while (place := self._magic_from(place)) is not None:
            decoded = self._decode(place)
            if decoded is None:
                place += 1
                continue
            yield place, decoded[0]
            place = decoded[1]


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def parse_record(record: bytes) -> dict:
    """Type, page, reference, URI and payload facts; a response's digest is taken from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    named = _headers(head)
    block = rest[: int(named.get("content-length") or 0)]
    http, _, payload = block.partition(b"\r\n\r\n")
    urn = lambda name: re.sub(r"^<urn:page:(.*)>$", r"\1", named[name]) or None if name in named else None
    stated = named.get("warc-payload-digest", "").removeprefix("sha1:")
    response = named.get("warc-type") == "response"
    digest = base32_sha1(payload) if response else stated
    length = len(payload) if response else int(_headers(http).get("content-length") or 0)
    return {
        "record_type": named.get("warc-type"), "page": urn("warc-record-id"), "refers": urn("warc-refers-to"),
        "uri": named.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest,
        "intact": digest == stated, "payload": payload if response else b"",
    }


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """The records of archives (path, bytes), by ranges of ``split_bytes``; one task may get several.

    Result: record_type, page, refers, uri, payload_bytes, payload_digest, intact (the digest read
    equals the stated one), path, offset and, if wanted, payload.
    """
    offsets = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = settle(archives.select("path", F.explode(offsets).alias("start")))
    count = max(1, min(ranges.count(), 4 * partitions(archives.sparkSession)))
    names = [*FIELDS, "payload"] if payloads else FIELDS
    kinds = pa.schema([
        ("record_type", pa.string()), ("page", pa.string()), ("refers", pa.string()), ("uri", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("path", pa.string()),
        ("offset", pa.int64()), ("payload", pa.binary()),
    ])
    kinds = pa.schema([kinds.field(name) for name in names])

    def read(batches):
        for batch in batches:
            for place, start in zip(*(column.to_pylist() for column in batch.columns)):
                system, path = file_system(place)
                held, size = [], 0
                with system.open_input_file(path) as source:
                    for offset, record in RangeReader(source, start, start + split_bytes):
                        held.append(parse_record(record) | {"path": place, "offset": offset})
                        size += len(record) if payloads else 500
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    schema = RECORD + (", payload binary" if payloads else "")
    return ranges.repartition(count).mapInArrow(read, schema)


def read_whole(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """``read_archives``, written; an error if an archive gave other than its number of ``records``."""
    records = settle(read_archives(archives, split_bytes, payloads))
    found = records.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    wrong = archives.join(found, "path", "left").where(F.coalesce("found", F.lit(0)) != F.col("records"))
    worst = wrong.select("path", "records", F.coalesce("found", F.lit(0)).alias("found")).first()
    if worst is not None:
        raise ValueError(f"{worst['path']} has {worst['records']} records, but {worst['found']} could be read")
    return records
