"""Ranked lexical search: MaxScore with bounds on pairs of terms.

Documents are indexed in blocks, each a part of a file in the shared folder: a dictionary, one posting list
per term and the documents' lengths. Queries are cut into chunks of bounded size, also on files, so that a
task holds one block and one chunk at a time whatever the number of either.

For every block and every pair of neighboring query terms the joint maximum is computed once: the largest
sum of both impacts over the documents of the pair's intersection list. A document gets from a pair no more
than that, or the larger of the single maxima if it has only one of them, which is mostly far below the sum
of both. When a query is run, its terms are matched into pairs by what that saves; the bounds of the
smallest terms are added up until they reach the score to beat, those terms only complete the scores of
documents found through the others, and a candidate is dropped as soon as its bound falls short. The score
to beat starts from the lists too: where the k-th best of one list stands, the k-th best of a query does.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediadate.llm.common import LOWER, UPPER, file_system, partitions, settle, shared_folder

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 13
CHUNK_ITEMS = 1000
CHUNK_TERMS = 1 << 18
BLOCKS_A_TASK = 16

# Fixed values of the score.
SCALE, TF_SCALE, LENGTH_SCALE, BASE, SLOPE = 1_000_000_000, 1000, 12, 100, 25


def _lower_table() -> np.ndarray:
    """Per byte: 0 for a separator, otherwise the byte, A-Z lower-cased."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    for upper, lower in zip(UPPER.encode(), LOWER.encode()):
        table[upper] = lower
    return table


def cut_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, in order, and the text each one is from; null texts have none."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    low, bounds = _lower_table()[raw], offsets - offsets[0]
    inside = low != 0
    cut = np.zeros(len(low) + 1, bool)
    cut[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    starts = np.flatnonzero(start)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside].tobytes())])
    return terms, np.searchsorted(bounds, starts, side="right") - 1


class Block:
    """Postings of some documents: term k has ``docs`` and ``counts`` from ``starts[k]`` to ``starts[k + 1]``."""

    def __init__(self, ids: pa.Array, lengths, terms: pa.Array, starts, docs, counts):
        self.ids, self.lengths, self.terms = ids, lengths, terms
        self.starts, self.docs, self.counts = starts, docs, counts

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Block:
        terms, owners = cut_terms(texts)
        encoded = terms.dictionary_encode()
        width = max(1, len(ids))
        codes = encoded.indices.to_numpy().astype(np.int64) * width + owners
        keys, counts = np.unique(codes, return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(encoded.dictionary) + 1) * width)
        return cls(ids, np.bincount(owners, minlength=len(ids)), encoded.dictionary, starts, keys % width, counts)

    def write(self, out) -> tuple[int, int]:
        """Append to an open file; where it starts and where its dictionary ends."""
        begin = out.tell()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("terms", pa.large_binary()), ("sizes", pa.int32())]), options=_zstd()) as stream:
            stream.write_batch(pa.record_batch([self.terms, pa.array(np.diff(self.starts), pa.int32())], ["terms", "sizes"]))
        out.write(sink.getvalue())
        middle = out.tell()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("docs", pa.uint32()), ("counts", pa.uint32())]), options=_zstd()) as stream:
            stream.write_batch(pa.record_batch([pa.array(self.docs, pa.uint32()), pa.array(self.counts, pa.uint32())], ["docs", "counts"]))
        lengths = pa.array(self.lengths, pa.int64())
        with pa.ipc.new_stream(sink, pa.schema([("ids", self.ids.type), ("lengths", pa.int64())]), options=_zstd()) as stream:
            stream.write_batch(pa.record_batch([self.ids, lengths], ["ids", "lengths"]))
        out.write(sink.getvalue())
        return begin, middle

    @staticmethod
    def dictionary(source, begin: int, middle: int) -> tuple[pa.Array, np.ndarray]:
        table = pa.ipc.open_stream(source.read_at(middle - begin, begin)).read_all().combine_chunks()
        terms = table.column("terms")
        return terms.chunk(0) if terms.num_chunks else pa.array([], pa.large_binary()), table.column("sizes").to_numpy()

    @classmethod
    def read(cls, source, begin: int, middle: int, end: int) -> Block:
        terms, sizes = cls.dictionary(source, begin, middle)
        rest = pa.BufferReader(source.read_at(end - middle, middle))
        postings = pa.ipc.open_stream(rest).read_all()
        told = pa.ipc.open_stream(rest).read_all()
        starts = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        docs, counts = (postings.column(n).to_numpy().astype(np.int64) for n in ("docs", "counts"))
        ids = told.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return cls(ids, told.column("lengths").to_numpy(), terms, starts, docs, counts)


def _zstd() -> pa.ipc.IpcWriteOptions:
    return pa.ipc.IpcWriteOptions(compression="zstd")


FILES = "path string, begin long, middle long, end long, docs long, terms long"


def build_index(docs: DataFrame) -> DataFrame:
    """Write the index; the written list of its blocks, with how many documents have terms and all their terms.

    A block holds at most 8,192 documents and 8 MB of text, or one longer text.
    """
    folder = shared_folder(docs.sparkSession)

    def build(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name, told = uuid.uuid4().hex, []
        with system.open_output_stream(f"{path}/{name}.blocks", compression=None) as out:
            for ids, texts in _blocks(batches):
                block = Block.of(ids, texts)
                begin, middle = block.write(out)
                told.append((f"{folder}/{name}.blocks", begin, middle, out.tell(), int((block.lengths > 0).sum()), int(block.lengths.sum())))
        if told:
            names = [part.split()[0] for part in FILES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*told)], names)

    return settle(docs.select("doc_id", "text").mapInArrow(build, FILES))


def _blocks(batches):
    """Ids and texts of the rows, in runs of bounded number and size."""
    ids, texts, rows, size = [], [], 0, 0
    for batch in batches:
        lengths = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))])
        k = 0
        while k < batch.num_rows:
            room = np.searchsorted(lengths, lengths[k] + BLOCK_BYTES - size, side="right") - 1
            stop = min(int(room), k + BLOCK_DOCS - rows, batch.num_rows)
            if stop <= k and not rows:
                stop = k + 1
            if stop > k:
                ids.append(batch.column(0).slice(k, stop - k))
                texts.append(batch.column(1).slice(k, stop - k))
                rows, size, k = rows + stop - k, size + int(lengths[stop] - lengths[k]), stop
            if k < batch.num_rows:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, rows, size = [], [], 0, 0
    if rows:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


# --- queries

def write_chunks(items: DataFrame) -> list[str]:
    """Write the queries ``item_id, text`` as chunks of bounded size; the files' names."""
    folder = shared_folder(items.sparkSession)
    table = _lower_table().tobytes().replace(b"\0", b" ")

    def write(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        ids, lists, size = [], [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(item)
                lists.append((text or "").encode("utf-8", "surrogatepass").translate(table).split())
                size += len(lists[-1])
                if len(ids) >= CHUNK_ITEMS or size >= CHUNK_TERMS:
                    yield put(system, path, ids, lists, batch.schema.field(0).type)
                    ids, lists, size = [], [], 0
        if ids:
            yield put(system, path, ids, lists, batch.schema.field(0).type)

    def put(system, path, ids, lists, kind):
        name = f"{uuid.uuid4().hex}.queries"
        table = pa.table({"item_id": pa.array(ids, kind), "terms": pa.array(lists, pa.list_(pa.large_binary()))})
        with system.open_output_stream(f"{path}/{name}", compression=None) as out, pa.ipc.new_file(out, table.schema) as sink:
            sink.write_table(table)
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    names = settle(items.select("item_id", "text").mapInArrow(write, "path string"))
    return sorted(row["path"] for row in names.collect())


class Chunk:
    """Queries of one file: distinct terms with repeats, pairs of neighboring terms, weights and scores to beat."""

    def __init__(self, path: str, counts_path: str | None, floors_path: str | None, documents: int):
        system, place = file_system(path)
        with system.open_input_file(place) as source:
            table = pa.ipc.open_file(source).read_all().combine_chunks()
        self.item_ids = table.column("item_id")
        lists = table.column("terms").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        encoded = lists.flatten().dictionary_encode()
        self.vocabulary = encoded.dictionary
        found = numbers_of(counts_path, len(self.vocabulary))
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in found], np.int64)
        self.floors = numbers_of(floors_path, len(lists))
        codes, ends = encoded.indices.to_numpy(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
        self.terms, self.repeats, self.pairs, pair_of = [], [], [], {}
        for k in range(len(lists)):
            own = codes[ends[k] : ends[k + 1]]
            distinct, repeats = np.unique(own, return_counts=True)
            near = {tuple(sorted(pair)) for pair in zip(own[:-1].tolist(), own[1:].tolist()) if pair[0] != pair[1]}
            where = {term: place for place, term in enumerate(distinct.tolist())}
            self.terms.append(distinct)
            self.repeats.append(repeats)
            self.pairs.append([(where[a], where[b], pair_of.setdefault((a, b), len(pair_of))) for a, b in sorted(near)])
        self.all_pairs = list(pair_of)


def numbers_of(path: str | None, size: int) -> np.ndarray:
    numbers = np.zeros(size, np.int64)
    if path is not None:
        system, place = file_system(path)
        with system.open_input_file(place) as source:
            places, values = np.frombuffer(source.read(), np.int64).reshape(2, -1)
        numbers[places] = values
    return numbers


def write_numbers(rows: DataFrame, chunks: int) -> list[str | None]:
    """Write ``chunk, place, value`` as one file a chunk; the names by chunk, none for chunks without rows."""
    folder = shared_folder(rows.sparkSession)

    def write(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        held: dict[int, list] = {}
        for batch in batches:
            chunk, place, value = (batch.column(k).to_numpy() for k in range(3))
            for number in np.unique(chunk).tolist():
                held.setdefault(number, []).append((place[chunk == number], value[chunk == number]))
        for number, parts in held.items():
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                for side in zip(*parts):
                    out.write(np.concatenate(side).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int32()), "path": [f"{folder}/{name}"]})

    written = settle(rows.select("chunk", "place", "value").repartition(max(1, chunks), "chunk").mapInArrow(write, "chunk int, path string"))
    names = {row["chunk"]: row["path"] for row in written.collect()}
    return [names.get(k) for k in range(chunks)]


def dealt_blocks(files: DataFrame) -> DataFrame:
    count = files.count()
    return files.repartition(max(1, min(count, max(partitions(files.sparkSession), count // BLOCKS_A_TASK))))


def document_counts(files: DataFrame, chunks: list[str]) -> DataFrame:
    """``chunk, place, value``: in how many documents each term of a chunk stands."""

    def count(batches):
        blocks = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
        for number, path in enumerate(chunks):
            chunk = Chunk(path, None, None, 0)
            total = np.zeros(len(chunk.vocabulary), np.int64)
            for place, begin, middle in blocks:
                system, at = file_system(place)
                with system.open_input_file(at) as source:
                    terms, sizes = Block.dictionary(source, begin, middle)
                ids = known(terms, chunk.vocabulary)
                total[ids[ids >= 0]] += sizes[ids >= 0]
            where = np.flatnonzero(total)
            if len(where):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), number, np.int32)), pa.array(where), pa.array(total[where])], ["chunk", "place", "value"])

    rows = dealt_blocks(files.select("path", "begin", "middle")).mapInArrow(count, "chunk int, place long, value long")
    return rows.groupBy("chunk", "place").agg(F.sum("value").alias("value"))


def known(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Per term its place in the vocabulary, or -1."""
    if not len(vocabulary) or not len(terms):
        return np.full(len(terms), -1, np.int64)
    return pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy().astype(np.int64)


class Impacts:
    """Impacts of a chunk's terms in a block: documents and impacts of each, and the largest one (0: none)."""

    def __init__(self, block: Block, chunk: Chunk, documents: int, terms: int):
        ids = known(block.terms, chunk.vocabulary)
        here = np.flatnonzero(ids >= 0)
        sizes = block.starts[here + 1] - block.starts[here]
        ends = np.cumsum(sizes)
        spots = np.repeat(block.starts[here] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        self.docs, tf = block.docs[spots], block.counts[spots]
        norm = BASE - SLOPE + SLOPE * block.lengths * documents // max(1, terms)
        weights = np.repeat(chunk.weights[ids[here]], sizes)
        self.impacts = weights * ((SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * norm[self.docs]))
        self.begins, self.ends = np.zeros(len(chunk.vocabulary), np.int64), np.zeros(len(chunk.vocabulary), np.int64)
        self.begins[ids[here]], self.ends[ids[here]] = ends - sizes, ends
        self.most = np.zeros(len(chunk.vocabulary), np.int64)
        if len(here):
            self.most[ids[here]] = np.maximum.reduceat(self.impacts, ends - sizes)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        place = slice(self.begins[term], self.ends[term])
        return self.docs[place], self.impacts[place]

    def intersection(self, one: int, two: int) -> np.ndarray:
        """Joint impacts of the documents that hold both terms."""
        (docs, impacts), (other, more) = sorted((self.postings(one), self.postings(two)), key=lambda p: len(p[0]))
        place = np.minimum(np.searchsorted(other, docs), max(0, len(other) - 1))
        both = other[place] == docs if len(other) else np.zeros(0, bool)
        return impacts[both] + more[place[both]] if len(other) else impacts[:0]


def _last(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, -k)[-k]) if len(values) >= k else 0


def joint_maxima(impacts: Impacts, chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per pair the joint maximum in the block (0: no document has both); per query a score that k documents reach."""
    most, reached = np.zeros(len(chunk.all_pairs), np.int64), np.zeros(len(chunk.all_pairs), np.int64)
    for pair, (one, two) in enumerate(chunk.all_pairs):
        if impacts.most[one] and impacts.most[two]:
            joint = impacts.intersection(one, two)
            if len(joint):
                most[pair], reached[pair] = joint.max(), _last(joint, k)
    single = np.zeros(len(chunk.vocabulary), np.int64)
    for term in np.flatnonzero(impacts.ends - impacts.begins >= k):
        single[term] = _last(impacts.postings(term)[1], k)
    floors = np.zeros(len(chunk.terms), np.int64)
    for query, (terms, pairs) in enumerate(zip(chunk.terms, chunk.pairs)):
        floors[query] = max([*single[terms].tolist(), *(reached[pair] for _, _, pair in pairs)], default=0)
    return most, floors


JOINT = "path string, begin long, middle long, end long, chunk int, joint binary, place long, value long"


def pair_maxima(files: DataFrame, chunks: list[str], counts: list[str | None], documents: int, terms: int, k: int) -> DataFrame:
    """Per block and chunk the joint maxima of its pairs, and per chunk and query (``place``) a score to beat, written."""
    names = [part.split()[0] for part in JOINT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def work(batches):
        blocks = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
        for number, path in enumerate(chunks if blocks else []):
            chunk = Chunk(path, counts[number], None, documents)
            floors = np.zeros(len(chunk.terms), np.int64)
            for place, *spot in blocks:
                most, own = joint_maxima(Impacts(_block(place, spot), chunk, documents, terms), chunk, k)
                np.maximum(floors, own, out=floors)
                joint = pa.compress(most.tobytes(), "zstd", asbytes=True)
                row = [[place], *([at] for at in spot), [number], [joint], [None], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(row, kinds)], names)
            where = np.flatnonzero(floors)
            if len(where):
                none = [None] * len(where)
                columns = [none, none, none, none, [number] * len(where), none, where, floors[where]]
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names)

    return settle(dealt_blocks(files.select("path", "begin", "middle", "end")).mapInArrow(work, JOINT))


def _block(place: str, spot: list[int]) -> Block:
    system, at = file_system(place)
    with system.open_input_file(at) as source:
        return Block.read(source, *spot)


def bounds(most: np.ndarray, pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[int]]:
    """Terms by ascending maximum, and what the first of them add to a score at most, one more each time.

    ``pairs`` are places of two terms and the most that both give together. Pairs are matched by what
    their joint bound saves; a matched pair counts with its bound once both terms are in.
    """
    order = np.argsort(most, kind="stable")
    order = order[most[order] > 0]
    partner: dict[int, tuple[int, int]] = {}
    savings = []
    for one, two, joint in pairs:
        high = max(int(most[one]), int(most[two]), joint)
        saved = int(most[one]) + int(most[two]) - high
        if saved > 0:
            savings.append((saved, one, two, high))
    for _, one, two, high in sorted(savings, key=lambda s: (-s[0], s[1:])):
        if one not in partner and two not in partner:
            partner[one], partner[two] = (two, high), (one, high)
    sums, seen = [0], set()
    for term in order.tolist():
        mate, high = partner.get(term, (None, 0))
        sums.append(sums[-1] + (high - int(most[mate]) if mate in seen else int(most[term])))
        seen.add(term)
    return order, sums


def search_block(impacts: Impacts, chunk: Chunk, query: int, joint: np.ndarray, size: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block that can be among a query's best, with their whole scores: at least ``floor``, above 0."""
    terms, repeats = chunk.terms[query], chunk.repeats[query]
    most = impacts.most[terms] * repeats
    pairs = [(one, two, int(joint[pair]) * int(max(repeats[one], repeats[two]))) for one, two, pair in chunk.pairs[query]]
    order, sums = bounds(most, pairs)
    few = sum(bound < floor for bound in sums[1:])
    if few == len(order):
        return order[:0], order[:0]
    scores = np.zeros(size, np.int64)
    for place in order[few:].tolist():
        docs, own = impacts.postings(terms[place])
        scores[docs] += own * repeats[place]
    found = np.flatnonzero(scores)
    for rank in range(few - 1, -1, -1):
        found = found[scores[found] + sums[rank + 1] >= floor]
        if not len(found):
            break
        place = int(order[rank])
        docs, own = impacts.postings(terms[place])
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        scores[found] += np.where(docs[at] == found, own[at], 0) * repeats[place]
    found = found[scores[found] >= max(1, floor)]
    return found, scores[found]


def _best(held: list, k: int) -> list:
    return sorted(held, key=lambda row: (-row[0], row[1] is None, row[1]))[:k]


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of ``items`` (``item_id, text``).

    Equal scores are ranked by ascending doc_id, null last; only scores above 0 count. Null and empty texts
    have no terms, neither as documents nor as queries; texts of any length are indexed whole. Repeated
    documents and repeated items are rows of their own; an empty table gives an empty result; other columns
    are not read. The driver holds names of files and the two sums that the score needs.
    """
    spark = docs.sparkSession
    doc_type, item_type = (frame.schema[name].dataType.simpleString() for frame, name in ((docs, "doc_id"), (items, "item_id")))
    files = build_index(docs)
    documents, terms = files.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    chunks = write_chunks(items)
    counts = write_numbers(document_counts(files, chunks), len(chunks))
    maxima = pair_maxima(files, chunks, counts, documents, terms, k)
    reached = maxima.where("place is not null").groupBy("chunk", "place").agg(F.max("value").alias("value"))
    floors = write_numbers(reached, len(chunks))
    blocks = maxima.where("place is null").select("path", "begin", "middle", "end", "chunk", "joint")
    tasks = max(1, min(blocks.count(), max(partitions(spark), files.count() // BLOCKS_A_TASK)))

    def work(batches):
        chunk, number, held, sizes = None, None, [], []
        for batch in batches:
            for place, *spot, chunk_number, joint in zip(*(column.to_pylist() for column in batch.columns)):
                if chunk_number != number:
                    if chunk is not None:
                        yield told(number, chunk, held)
                    number = chunk_number
                    chunk = Chunk(chunks[number], counts[number], floors[number], documents)
                    held, beat = [[] for _ in chunk.terms], chunk.floors.tolist()
                block = _block(place, spot)
                impacts = Impacts(block, chunk, documents, terms)
                pairs = np.frombuffer(pa.decompress(joint, 8 * len(chunk.all_pairs), "zstd", asbytes=True) if len(chunk.all_pairs) else b"", np.int64)
                for query in range(len(chunk.terms)):
                    found, scores = search_block(impacts, chunk, query, pairs, len(block.lengths), beat[query])
                    if len(found):
                        least = _last(scores, k)
                        found, scores = found[scores >= least], scores[scores >= least]
                        ids = block.ids.take(pa.array(found)).to_pylist()
                        held[query] = _best(held[query] + list(zip(scores.tolist(), ids)), k)
                        if len(held[query]) == k:
                            beat[query] = max(beat[query], held[query][-1][0])
        if chunk is not None:
            yield told(number, chunk, held)

    id_type = _arrow_type(docs, "doc_id")

    def told(number, chunk, held):
        rows = [(query, score, doc) for query, best in enumerate(held) for score, doc in best]
        queries, scores, found = zip(*rows) if rows else ((), (), ())
        item_ids = chunk.item_ids.take(pa.array(queries, pa.int64())).combine_chunks()
        item_ids = item_ids.chunk(0) if isinstance(item_ids, pa.ChunkedArray) else item_ids
        columns = [pa.array([number] * len(rows), pa.int32()), pa.array(queries, pa.int64()), item_ids, pa.array(found, id_type), pa.array(scores, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "query", "item_id", "doc_id", "score"])

    dealt = blocks.repartition(tasks).sortWithinPartitions("chunk")
    found = dealt.mapInArrow(work, f"chunk int, query long, item_id {item_type}, doc_id {doc_type}, score long")
    order = Window.partitionBy("chunk", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _arrow_type(frame: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[name].dataType)
