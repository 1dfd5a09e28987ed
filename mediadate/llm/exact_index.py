"""Exact duplicates through an extendible-hash index on shared files.

The unsigned 64-bit hash of a text is its key. Key space is cut into equal ranges, each with one owner
task, which keeps an extendible hash table of the texts in its range: a directory over the next bits of
the key names buckets, a bucket over ``BUCKET`` keys is split in two, and the directory doubles when the
bucket's bits are all it has. Texts with one key form a chain; an entry is found only by comparing bytes.

Map tasks combine equal texts before the shuffle, so an owner gets a text once a map task at most. The
owner appends distinct texts to compressed blocks on shared files and holds keys, places and counts, not
texts. Buckets are written as pages, with the directory beside them; later texts are looked up there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import file_system, join_lookup, partitions, settle, shared_folder

BUCKET = 512
DEEPEST = 24
OWNER_BYTES = 256 << 20
COMBINED_BYTES = 32 << 20
BLOCK_BYTES = 128 << 10
FILE_BYTES = 32 << 20
CACHED_BYTES = 8 << 20
ALL_BITS = (1 << 64) - 1


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _merge(entry: list, keep, copies: int, ties: int) -> None:
    """Add copies to ``[keep, copies, ties, ...]``; ties counts the rows with the id that stays."""
    entry[1] += copies
    if keep == entry[0]:
        entry[2] += ties
    elif entry[0] is None or (keep is not None and keep > entry[0]):
        entry[0], entry[2] = keep, ties


class TextHeap:
    """Texts appended in compressed blocks to files of bounded size.

    A store may not show a file before it is closed, so the blocks of the file being filled stay in memory.
    """

    def __init__(self, place: str):
        self.system, self.path = file_system(place)
        self.codec = pa.Codec("zstd", 1)
        self.blocks: list[tuple[int, int, int, int]] = []  # file, start, stored bytes, bytes
        self.file, self.filling, self.filled, self.first = 0, [], 0, 0
        self.block = bytearray()
        self.cache: OrderedDict[int, bytes] = OrderedDict()
        self.cached = 0

    def add(self, text: bytes) -> tuple[int, int]:
        place = len(self.blocks), len(self.block)
        self.block += text
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()
        return place

    def _close_block(self) -> None:
        stored = self.codec.compress(bytes(self.block), asbytes=True)
        self.blocks.append((self.file, self.filled, len(stored), len(self.block)))
        self.filling.append(stored)
        self.filled += len(stored)
        self.block = bytearray()
        if self.filled >= FILE_BYTES:
            self._close_file()

    def _close_file(self) -> None:
        with self.system.open_output_stream(f"{self.path}.{self.file}.texts", compression=None) as out:
            for stored in self.filling:
                out.write(stored)
        self.file, self.filling, self.filled, self.first = self.file + 1, [], 0, len(self.blocks)

    def close(self) -> None:
        if self.block:
            self._close_block()
        if self.filling:
            self._close_file()

    def read(self, block: int, offset: int, length: int) -> bytes:
        if block == len(self.blocks):
            return bytes(self.block[offset : offset + length])
        held = self.cache.pop(block, None)
        if held is None:
            file, start, stored, size = self.blocks[block]
            if file == self.file and block >= self.first and self.filling:
                packed = self.filling[block - self.first]
            else:
                with self.system.open_input_file(f"{self.path}.{file}.texts") as source:
                    packed = source.read_at(stored, start)
            held = self.codec.decompress(packed, size, asbytes=True)
            self.cached += size
        self.cache[block] = held
        while self.cached > CACHED_BYTES and len(self.cache) > 1:
            self.cached -= len(self.cache.popitem(last=False)[1])
        return held[offset : offset + length]


class Bucket:
    def __init__(self, depth: int):
        self.depth = depth
        self.chains: dict[int, list[list]] = {}


class ExtendibleIndex:
    """Directory and buckets of one owner; ``skip`` leading key bits are the owner's own."""

    def __init__(self, skip: int, heap: TextHeap):
        self.skip, self.heap = skip, heap
        self.depth, self.directory = 0, [Bucket(0)]

    def _slot(self, key: int) -> int:
        return (key << self.skip & ALL_BITS) >> (64 - self.depth)

    def add(self, key: int, text: bytes, keep, copies: int, ties: int) -> None:
        bucket = self.directory[self._slot(key)]
        chain = bucket.chains.get(key, ())
        for entry in chain:
            if entry[5] == len(text) and self.heap.read(entry[3], entry[4], entry[5]) == text:
                return _merge(entry, keep, copies, ties)
        while not chain and len(bucket.chains) >= BUCKET and bucket.depth < min(DEEPEST, 64 - self.skip):
            self._split(key, bucket)
            bucket = self.directory[self._slot(key)]
        digest = hashlib.sha256(text).digest()
        if any(entry[6] == digest for entry in chain):
            raise ValueError("two texts with one key and one SHA-256")
        place = self.heap.add(text)
        bucket.chains.setdefault(key, []).append([keep, copies, ties, *place, len(text), digest])

    def _split(self, key: int, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.directory = [held for held in self.directory for _ in range(2)]
            self.depth += 1
        span = 1 << (self.depth - bucket.depth)
        start = self._slot(key) // span * span
        halves = Bucket(bucket.depth + 1), Bucket(bucket.depth + 1)
        self.directory[start : start + span // 2] = [halves[0]] * (span // 2)
        self.directory[start + span // 2 : start + span] = [halves[1]] * (span // 2)
        for held, chain in bucket.chains.items():
            halves[self._slot(held) >= start + span // 2].chains[held] = chain

    def write(self, keep_type: pa.DataType) -> dict:
        """Write pages, directory and block places; the numbers that describe them."""
        self.heap.close()
        system, path = self.heap.system, self.heap.path
        names = ["key", "keep_id", "copies", "ties", "block", "offset", "length", "text_sha256"]
        kinds = [pa.uint64(), keep_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds)))
        pages, page_of, entries = [], {}, 0
        with system.open_output_stream(f"{path}.pages", compression=None) as out, pa.ipc.new_file(out, schema) as sink:
            for bucket in self.directory:
                if id(bucket) not in page_of:
                    page_of[id(bucket)] = len(page_of)
                    rows = [(key, *entry) for key, chain in bucket.chains.items() for entry in chain]
                    columns = list(zip(*rows)) if rows else [[]] * len(names)
                    sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema))
                    entries += len(rows)
                pages.append(page_of[id(bucket)])
        blocks = np.array(self.heap.blocks, np.int64).reshape(-1, 4)
        with system.open_output_stream(f"{path}.directory", compression=None) as out:
            out.write(np.array([self.depth, self.skip], np.int64).tobytes())
            out.write(np.array(pages, np.int64).tobytes())
            out.write(blocks.tobytes())
        return {"entries": entries, "buckets": len(page_of), "depth": self.depth}


class IndexReader:
    """Finds texts in the written index of one owner, reading one page and one block at a time."""

    def __init__(self, place: str):
        self.heap = TextHeap(place)
        system, path = self.heap.system, self.heap.path
        with system.open_input_file(f"{path}.directory") as source:
            numbers = np.frombuffer(source.read(), np.int64)
        self.depth, self.skip = int(numbers[0]), int(numbers[1])
        slots = 1 << self.depth
        self.directory = numbers[2 : 2 + slots]
        self.heap.blocks = [tuple(row) for row in numbers[2 + slots :].reshape(-1, 4).tolist()]
        self.file = system.open_input_file(f"{path}.pages")
        self.pages = pa.ipc.open_file(self.file)
        self.page, self.chains = None, {}

    def find(self, key: int, text: bytes):
        """keep_id and copies of the entry with these bytes, or nothing."""
        page = int(self.directory[(key << self.skip & ALL_BITS) >> (64 - self.depth)])
        if page != self.page:
            columns = self.pages.get_batch(page).to_pydict()
            self.page, self.chains = page, {}
            for held, *entry in zip(*(columns[n] for n in ("key", "keep_id", "copies", "block", "offset", "length"))):
                self.chains.setdefault(held, []).append(entry)
        for keep, copies, *place in self.chains.get(key, ()):
            if place[2] == len(text) and self.heap.read(*place) == text:
                return keep, copies
        return None


def keyed_rows(docs: DataFrame, key=text_key) -> DataFrame:
    """doc_id, key, n_bytes, text_sha256 and a row number (any) of every row, written."""
    text = F.coalesce("text", F.lit(""))
    return settle(docs.select(
        "doc_id", key(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    ))


def build_index(docs: DataFrame, n_bytes: int, key=text_key) -> DataFrame:
    """Index the texts of ``docs``, some ``n_bytes`` of UTF-8; the written list of index files, one a key range.

    Columns: owner, skip, path, entries, buckets, depth. Null texts are empty, null doc_ids come before all
    others. An empty table gives an empty list. A text may be of any length, but has to fit a task's memory.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    skip = max(1, (max(partitions(spark), n_bytes // OWNER_BYTES) - 1).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def combine(batches):
        held, size = {}, 0
        for batch in batches:
            for keep, key, text in zip(*(column.to_pylist() for column in batch.columns)):
                entry = held.get((key, text))
                if entry is None:
                    held[key, text] = [keep, 1, 1]
                    size += len(text) + 200
                else:
                    _merge(entry, keep, 1, 1)
            if size > COMBINED_BYTES:
                yield from _entries(held, batch.schema.field(0).type)
                held, size = {}, 0
        if held:
            yield from _entries(held, batch.schema.field(0).type)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", key(text).alias("key"), text.cast("binary").alias("text"))
    entries = rows.mapInArrow(combine, f"key long, text binary, keep_id {kind}, copies long, ties long")
    owner = F.shiftrightunsigned("key", 64 - skip).cast("int")
    dealt = entries.withColumn("owner", owner).repartitionById(1 << skip, "owner")

    def own(batches):
        index = None
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            if index is None and batch.num_rows:
                place, owner = f"{folder}/{uuid.uuid4().hex}", columns[5][0]
                system, path = file_system(folder)
                system.create_dir(path, recursive=True)
                index, keep_type = ExtendibleIndex(skip, TextHeap(place)), batch.schema.field(2).type
            for key, text, keep, copies, ties, _ in zip(*columns):
                index.add(key & ALL_BITS, text, keep, copies, ties)
        if index is not None:
            told = {"owner": owner, "skip": skip, "path": place} | index.write(keep_type)
            yield pa.RecordBatch.from_pylist([told], FILES)

    return settle(dealt.mapInArrow(own, "owner int, skip int, path string, entries long, buckets long, depth long"))


FILES = pa.schema([("owner", pa.int32()), ("skip", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("buckets", pa.int64()), ("depth", pa.int64())])


def _entries(held: dict, keep_type: pa.DataType):
    """The combined entries, in batches of bounded bytes."""
    rows, size = [], 0
    for (key, text), (keep, copies, ties) in held.items():
        rows.append((key, text, keep, copies, ties))
        size += len(text)
        if size > 4 << 20:
            yield _entry_batch(rows, keep_type)
            rows, size = [], 0
    if rows:
        yield _entry_batch(rows, keep_type)


def _entry_batch(rows: list, keep_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), keep_type, pa.int64(), pa.int64()]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key", "text", "keep_id", "copies", "ties"])


def read_groups(files: DataFrame, keep_type: str) -> DataFrame:
    """key, text_sha256, keep_id, group_size and ties of the texts that an index holds more than once."""

    def read(batches):
        for batch in batches:
            for place in batch.column(0).to_pylist():
                system, path = file_system(place)
                with system.open_input_file(f"{path}.pages") as source:
                    pages = pa.ipc.open_file(source)
                    for k in range(pages.num_record_batches):
                        page = pages.get_batch(k)
                        page = page.filter(pa.compute.greater(page.column("copies"), 1))
                        keys = pa.array(page.column("key").to_numpy().view(np.int64))
                        digests = pa.array([digest.hex() for digest in page.column("text_sha256").to_pylist()], pa.string())
                        columns = [keys, digests, page.column("keep_id"), page.column("copies"), page.column("ties")]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "text_sha256", "keep_id", "group_size", "ties"])

    places = files.select("path").repartition(max(1, files.count()), "path")
    return places.mapInArrow(read, f"key long, text_sha256 string, keep_id {keep_type}, group_size long, ties long")


def exact_groups(docs: DataFrame, key=text_key) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal if their bytes are; null is empty, and very long texts are compared whole. Of equal
    texts the row with the largest doc_id stays, null ids before all others; of rows equal in both, any
    one. Repeated rows stay rows of the result, an empty table gives an empty one, other columns are
    not read. Groups are joined back by key and SHA-256, which the index has found to tell its texts apart.
    """
    rows = keyed_rows(docs, key)
    n_bytes = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    files = build_index(docs, n_bytes, key)
    groups = settle(read_groups(files, docs.schema["doc_id"].dataType.simpleString()))
    named = join_lookup(rows, groups, ["key", "text_sha256"], "row", "left")
    alone = F.col("group_size").isNull()
    named = named.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if groups.where("ties > 1").limit(1).count():
        named = settle(named)
        first = named.where(kept & (F.col("ties") > 1)).groupBy("key", "text_sha256").agg(F.min("row").alias("first"))
        named = join_lookup(named, settle(first), ["key", "text_sha256"], "row", "left")
        kept = kept & (F.coalesce("first", "row") == F.col("row"))
    return named.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def find_texts(texts: DataFrame, files: DataFrame, keep_type: str, key=text_key) -> DataFrame:
    """``texts`` (any rows with ``text``) with ``found``, ``keep_id`` and ``copies`` from the index ``files``.

    Each key range is looked up by a task that opens that range's files alone. Null texts are empty.
    """
    spark = texts.sparkSession
    first = files.select("skip").first()
    numbered = settle(texts.withColumn("_row", F.monotonically_increasing_id()))
    none = F.lit(None)
    if first is None:
        return numbered.drop("_row").select("*", F.lit(False).alias("found"), none.cast(keep_type).alias("keep_id"), none.cast("long").alias("copies"))
    skip = first["skip"]
    text = F.coalesce("text", F.lit(""))
    asked = numbered.select("_row", key(text).alias("key"), text.cast("binary").alias("bytes"))
    asked = asked.withColumn("owner", F.shiftrightunsigned("key", 64 - skip).cast("int"))
    asked = join_lookup(asked, files.select("owner", "path"), ["owner"], "_row").repartition(partitions(spark), "owner", F.pmod("_row", F.lit(16)))
    asked = asked.sortWithinPartitions("owner", "key").select("path", "key", "bytes", "_row")

    def look(batches):
        now, reader = None, None
        for batch in batches:
            found = []
            for path, key, text, row in zip(*(column.to_pylist() for column in batch.columns)):
                if path != now:
                    now, reader = path, IndexReader(path)
                hit = reader.find(key & ALL_BITS, text)
                if hit is not None:
                    found.append((row, *hit))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*found)], ["_row", "keep_id", "copies"])

    hits = asked.mapInArrow(look, f"_row long, keep_id {keep_type}, copies long")
    return numbered.join(hits, "_row", "left").drop("_row").select(
        *(numbered[name] for name in texts.columns), F.col("copies").isNotNull().alias("found"), hits["keep_id"], hits["copies"],
    )
