"""Token ids in bit-packed files with random access.

A file holds the ids of a range of documents in ascending doc_id. Layout, all numbers little-endian:

    blocks   up to ``BLOCK_IDS`` ids each, lowest bit first, ``width`` bits an id, padded to a byte
    footer   doc starts (n_docs + 1 numbers of 64 bits), block offsets (one of 64 bits each)
    tail     ids, docs, blocks (64 bits each), width, ids per block (32 bits each), 8 bytes of magic

``width`` is the least that holds every id of the vocabulary. A document's ids lie in the blocks
from start // BLOCK_IDS on; block offsets lead to them, and numpy unpacks whole blocks.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import file_system, partitions, remembered, settle, shared_folder, text_parts

MAGIC = b"IDPACK01"
TAIL = "<QQQII8s"
BLOCK_IDS = 1 << 16
READ_IDS = 1 << 20
CACHED = 500_000
TEXT_BYTES = 1 << 21


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as a bit stream; an id that does not fit the width is an error."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a bit stream as unsigned 32-bit numbers."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype("<u4")
    bits = np.zeros((count, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class PackedWriter:
    """Writes documents to a stream; holds less than one block of ids beside the index."""

    def __init__(self, out, width: int):
        self.out, self.width, self.waiting = out, width, []
        self.pending, self.ids, self.place, self.starts, self.offsets = 0, 0, 0, [0], []

    def add(self, ids: np.ndarray) -> None:
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.pending += len(ids)
        if self.pending >= BLOCK_IDS:
            joined = np.concatenate(self.waiting)
            whole = self.pending // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(joined[k : k + BLOCK_IDS])
            self.waiting, self.pending = [joined[whole:].copy()], self.pending - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def close(self) -> int:
        """Write the rest and the footer; the file's bytes."""
        if self.pending:
            self._block(np.concatenate(self.waiting))
        footer = np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes()
        tail = struct.pack(TAIL, self.ids, len(self.starts) - 1, len(self.offsets), self.width, BLOCK_IDS, MAGIC)
        self.out.write(footer + tail)
        return self.place + len(footer) + len(tail)


class PackedReader:
    """Random access to the documents of a file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        length = struct.calcsize(TAIL)
        tail = struct.unpack(TAIL, source.read_at(length, size - length))
        self.ids, self.docs, blocks, self.width, self.block_ids, magic = tail
        if magic != MAGIC:
            raise ValueError("no file of packed ids")
        footer = 8 * (self.docs + 1 + blocks)
        self.data_end = size - length - footer
        numbers = np.frombuffer(source.read_at(footer, self.data_end), "<u8").astype(np.int64)
        self.starts, self.offsets = numbers[: self.docs + 1], numbers[self.docs + 1 :]

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` to ``end`` of the file."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        stops = [*self.offsets[first + 1 : last + 1].tolist(), self.data_end if last + 1 == len(self.offsets) else int(self.offsets[last + 1])]
        place = int(self.offsets[first])
        data = self.source.read_at(stops[-1] - place, place)
        parts = []
        for block, stop in zip(range(first, last + 1), stops):
            begin = int(self.offsets[block])
            count = min(self.block_ids, self.ids - block * self.block_ids)
            parts.append(unpack(data[begin - place : stop - place], self.width, count))
        return np.concatenate(parts)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, number: int) -> np.ndarray:
        return self.range(int(self.starts[number]), int(self.starts[number + 1]))

    def documents(self):
        """All documents' ids in order, some ``READ_IDS`` ids at a time."""
        number = 0
        while number < self.docs:
            start = int(self.starts[number])
            stop = max(number + 1, int(np.searchsorted(self.starts, start + READ_IDS, "right")) - 1)
            ids = self.range(start, int(self.starts[stop]))
            for k in range(number, stop):
                yield k, ids[self.starts[k] - start : self.starts[k + 1] - start]
            number = stop


# The normalisation and splitting for which pieces may be encoded one by one. White
# space is dropped before anything else, letters are lower-cased, and the rest is cut by a pattern.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLITTER = {
    "type": "Split", "behavior": "Removed", "invert": True,
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
}

# Pieces of these characters need no NFC, and each letter has one lower case of one character.
PLAINS = re.compile("[ !-~À-ÖØ-öø-ÿ]*")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+| ")
GAP = 0xFFFF_FFFF  # no id


class PieceEncoder:
    """Encodes texts by their distinct pieces between spaces, and remembers the parts of pieces.

    With the known normalisation and splitting a text's ids are those of its pieces one after the
    other, and a plain piece's ids are those of its parts. Any other tokenizer gets whole texts.
    The memory of parts, and of pieces that are not plain, starts anew at ``CACHED`` entries.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shape = json.loads(self.tokenizer.to_str())
        splits = (shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        added = [token["content"] for token in shape["added_tokens"]]
        self.by_piece = shape["normalizer"] == NORMALIZER and splits[0] == SPLITTER and not any(re.search(r"\s", t) for t in added)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        if self.by_piece:
            letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
            self.bytes_of = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part if part.isascii() else part.translate(self.bytes_of))
        return array("I", [token.id for token in tokens]).tobytes()

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are not plain."""
        missing = list(set(pieces).difference(self.pieces))
        for piece, encoded in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
            self.pieces[piece] = array("I", encoded.ids).tobytes()
        return [self.pieces[piece] for piece in pieces]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, and where in them those of each piece begin and end."""
        line, places, others = " ".join(pieces), [], []
        if not PLAINS.fullmatch(line) or self.added.search(line):
            places = [k for k, piece in enumerate(pieces) if not PLAINS.fullmatch(piece) or self.added.search(piece)]
            others = self._others([pieces[k] for k in places])
            hidden = set(places)
            line = " ".join("" if k in hidden else piece for k, piece in enumerate(pieces))
        # plain pieces are cut into parts all at once; the spaces between them leave gaps
        found = PART.findall(line.lower())
        self.parts[" "] = array("I", [GAP]).tobytes()
        for part in set(found).difference(self.parts):
            self.parts[part] = self._part(part)
        plain = b"".join(map(self.parts.__getitem__, found))
        gaps = np.flatnonzero(np.frombuffer(plain, np.uint32) == GAP)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(plain) // 4)
        if places:
            ends[places] = np.cumsum([len(ids) // 4 for ids in others]) + len(plain) // 4
            starts[places] = ends[places] - [len(ids) // 4 for ids in others]
        if len(self.parts) + len(self.pieces) > CACHED:
            self.parts.clear()
            self.pieces.clear()
        return np.frombuffer(b"".join([plain, *others]), np.uint32), starts, ends

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_piece:
            encoded = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(one.ids, "<u4") for one in encoded]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return []
        ids, starts, ends = self._encode_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy()
        sizes = (ends - starts)[codes]
        after = np.cumsum(sizes)
        joined = ids[np.repeat(starts[codes] - (after - sizes), sizes) + np.arange(after[-1])]
        last = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64)) - 1
        return np.split(joined.astype("<u4", copy=False), after[last[:-1]])


@remembered
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_texts(texts: pa.Array | list[str | None], path: str) -> list[np.ndarray]:
    """Ids of every text; null is empty. A worker keeps its encoder."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return _encoder(path).encode(texts.fill_null(pa.scalar("", texts.type)))


def write_token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    """Encode and write all texts, in ascending doc_id (null last) over the files.

    Texts are dealt out by ranges of doc_id; each task sorts, encodes and writes its range, so ids
    are never shuffled. A file's name is new for each attempt; the result lists the files that
    count: piece (their order), path, docs, ids.
    """
    spark = docs.sparkSession
    folder, width = shared_folder(spark), bit_width(vocabulary)
    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions(spark), order, F.xxhash64("text"))
    dealt = dealt.withColumn("piece", F.spark_partition_id()).sortWithinPartitions(order, F.xxhash64("text"))

    def write(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name, writer, piece, keys = uuid.uuid4().hex, None, None, []
        with system.open_output_stream(f"{path}/{name}.ids", compression=None) as out:
            writer = PackedWriter(out, width)
            for batch in batches:
                if batch.num_rows:
                    piece = batch.column(2)[0].as_py()
                keys.append(batch.column(0))
                for part in text_parts(batch, TEXT_BYTES):
                    for ids in encode_texts(part.column("text"), tokenizer):
                        writer.add(np.append(ids, np.uint32(end_id)))
            writer.close()
        if piece is not None:
            with system.open_output_stream(f"{path}/{name}.docs", compression=None) as out:
                table = pa.Table.from_arrays([pa.chunked_array(keys)], ["doc_id"])
                with pa.ipc.new_file(out, table.schema) as sink:
                    sink.write_table(table)
            docs_written = len(writer.starts) - 1
            yield pa.RecordBatch.from_pylist([{"piece": piece, "path": f"{folder}/{name}", "docs": docs_written, "ids": writer.ids}])

    return settle(dealt.mapInArrow(write, "piece long, path string, docs long, ids long"))


def read_token_files(files: DataFrame, doc_type: str = "long") -> DataFrame:
    """Per document of the files: doc_id, start (over all files), n_tokens, ids_crc32.

    The driver sums up one number per file. A task reads a file block by block.
    """
    spark = files.sparkSession
    rows, before = [], 0
    for row in files.orderBy("piece").collect():
        rows.append((row["path"], before))
        before += row["ids"]
    schema = f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long"
    plan = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def read(batches):
        for batch in batches:
            for place, base in zip(*(column.to_pylist() for column in batch.columns)):
                system, path = file_system(place)
                with system.open_input_file(f"{path}.docs") as source:
                    keys = pa.ipc.open_file(source).read_all().column(0).combine_chunks()
                with system.open_input_file(f"{path}.ids") as source:
                    reader = PackedReader(source)
                    sums = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in reader.documents()), np.int64, reader.docs)
                    starts, counts = reader.starts[:-1] + base, np.diff(reader.starts)
                keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(counts), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(read, schema)


def encode_documents(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    """Write the files and read them back: one row per row of ``docs``.

    Null and empty texts have the end id alone; very long ones are encoded whole and span blocks. Rows with one doc_id follow each other, in an order
    set by their texts. An empty table gives no files and an empty result. Other columns are not read.
    """
    files = write_token_files(docs, tokenizer, vocabulary, end_id)
    return read_token_files(files, docs.schema["doc_id"].dataType.simpleString())
