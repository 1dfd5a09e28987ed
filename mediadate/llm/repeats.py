"""Removal of long repeated byte strings by prefix-free parsing.

Parsing. The trigger of a window of ``length`` bytes is the k-byte string in it with the least
rolling hash (the leftmost of equal ones), so it depends on the window's bytes alone. Neighboring
windows with one trigger make a phrase: the bytes they cover. Phrases overlap by ``length - 1``
bytes, each window lies in exactly one, and equal windows lie at the same place before the trigger.

Dictionary and parse. Phrases are told apart by two 64-bit hashes, of the trigger (h) and of the
whole phrase (c). A phrase that stands there again repeats all of its windows, whatever it holds;
the rest of the work is on each phrase's first occurrence. Windows of different phrases can only be
equal if the triggers are. So the suffixes of the dictionary's phrases are sorted per trigger, to
the depth of ``length`` bytes, which the overlap covers; equal ones are neighbors in that corpus
order, and the one that starts first in the parse is kept.

Repetitive text shrinks to its dictionary, and text that nothing repeats is dropped once its
triggers are known to be single: first by a bitmap of fixed size over the repeated triggers, then
by an exact join.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import discard, remembered, settle

LENGTH, TRIGGER = 100, 32
SEGMENT_BITS = 20
SEGMENT = 1 << SEGMENT_BITS
BASE = 0x9E3779B97F4A7C15
MAP_BITS, BLOCK_BITS = 27, 15
GROUP = 20_000
LAST = (1 << 63) - 1


@remembered
def _powers(base: int) -> np.ndarray:
    factors = np.full(SEGMENT + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed polynomial hash of every string of ``width`` bytes."""
    powers, inverse = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    hashes = (sums[width:] - sums[:-width]) * inverse[: len(sums) - width]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ hashes >> np.uint64(29)


def parse_segment(data: np.ndarray, ends: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and trigger hash of every phrase.

    ``ends`` gives for each byte where its document ends in the segment.
    """
    windows = len(data) - length + 1
    valid = np.flatnonzero(ends[: max(0, windows)] - np.arange(max(0, windows)) >= length)
    if not len(valid):
        return valid, valid, valid.astype(np.uint64)
    hashes = rolling_hashes(data, width)
    low = np.uint64(SEGMENT_BITS)
    least = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    span, have = length - width + 1, 1
    while 2 * have <= span:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    triggers = (least[valid] & np.uint64(SEGMENT - 1)).astype(np.int64)
    cuts = np.flatnonzero((np.diff(triggers) != 0) | (np.diff(valid) != 1)) + 1
    first = np.concatenate([[0], cuts])
    return valid[first], np.diff(np.concatenate([first, [len(valid)]])), hashes[triggers[first]]


def segments(texts: list[bytes], length: int):
    """Texts joined to segments: owner numbers, offsets in the owner, lengths, the bytes.

    A text longer than a segment comes in pieces that overlap, so that each window is in one.
    """
    parts, size = [], 0
    for owner, text in enumerate(texts):
        if len(text) < length:
            continue
        for begin in range(0, max(1, len(text) - length + 1), SEGMENT - length + 1):
            piece = text[begin : begin + SEGMENT]
            if size + len(piece) > SEGMENT:
                yield parts
                parts, size = [], 0
            parts.append((owner, begin, piece))
            size += len(piece)
    if parts:
        yield parts


def phrases(texts: list[bytes], length: int, width: int):
    """Per segment: owners, starts, window counts, trigger hashes and places, and the bytes."""
    for parts in segments(texts, length):
        joined = b"".join(piece for _, _, piece in parts)
        sizes = np.array([len(piece) for _, _, piece in parts])
        edges = np.cumsum(sizes)
        places, counts, hashes = parse_segment(np.frombuffer(joined, np.uint8), np.repeat(edges, sizes), length, width)
        part = np.searchsorted(edges, places, "right")
        owners = np.array([owner for owner, _, _ in parts])[part]
        offsets = np.array([begin for _, begin, _ in parts]) - (edges - sizes)
        yield owners, places + offsets[part], counts, hashes.view(np.int64), places, joined


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null ids last), twin and the bytes; rows of one doc_id are told apart by their text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    repeated = docs.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count()
    twin = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return docs.select("doc_id", doc.alias("doc"), twin.alias("twin"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def repeated_triggers(keyed: DataFrame, length: int, width: int) -> DataFrame:
    """``h`` of the triggers that more than one phrase has."""

    def work(batches):
        for batch in batches:
            for _, _, _, hashes, _, _ in phrases(batch.column(0).to_pylist(), length, width):
                yield pa.RecordBatch.from_arrays([pa.array(hashes)], ["h"])

    rows = keyed.select("data").mapInArrow(work, "h long")
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def trigger_map(triggers: DataFrame) -> np.ndarray:
    """A bitmap of 2**27 bits over the first bits of the triggers, put together from blocks of 4 KB."""

    def work(batches):
        block, bits = None, None
        for batch in batches:
            numbers, places = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            ends = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for begin, end in itertools.pairwise(ends):
                if begin == end:
                    continue
                if numbers[begin] != block:
                    if block is not None:
                        yield _block(block, bits)
                    block, bits = numbers[begin], np.zeros(1 << BLOCK_BITS, bool)
                bits[places[begin:end]] = True
        if block is not None:
            yield _block(block, bits)

    def _block(block, bits):
        return pa.RecordBatch.from_pylist([{"block": int(block), "bits": np.packbits(bits, bitorder="little").tobytes()}])

    place = F.shiftrightunsigned("h", 64 - MAP_BITS)
    rows = triggers.select(F.shiftright(place, BLOCK_BITS).alias("block"), place.bitwiseAND((1 << BLOCK_BITS) - 1).alias("place"))
    rows = rows.repartition("block").sortWithinPartitions("block").mapInArrow(work, "block long, bits binary")
    found = np.zeros((1 << (MAP_BITS - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in rows.toLocalIterator():
        found[row["block"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return found.reshape(-1)


def repeated_phrases(keyed: DataFrame, triggers: DataFrame, length: int, width: int) -> DataFrame:
    """``h, c, doc, twin, start, n``: the phrases whose trigger is repeated."""
    bitmap = keyed.sparkSession.sparkContext.broadcast(trigger_map(triggers))

    def work(batches):
        known = bitmap.value
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            docs, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for owners, starts, counts, hashes, places, joined in phrases(batch.column(2).to_pylist(), length, width):
                place = (hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                kept = np.flatnonzero(known[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                spans = zip(places[kept].tolist(), (places[kept] + counts[kept] + length - 1).tolist())
                content = np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, len(kept)).view(np.int64)
                columns = [hashes[kept], content, docs[owners[kept]], twins[owners[kept]], starts[kept], counts[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int64)) for column in columns], ["h", "c", "doc", "twin", "start", "n"])

    rows = keyed.select("doc", "twin", "data").mapInArrow(work, "h long, c long, doc long, twin long, start long, n long")
    return rows.join(triggers, "h", "left_semi")


def equal_windows(contexts: list[bytes], order: np.ndarray, length: int) -> list[np.ndarray]:
    """Per context, which of its windows stand in an earlier one of the same trigger.

    ``contexts`` are phrases, ``order`` ranks the starts of their windows: a rank per context.
    The windows are sorted as byte strings; equal ones are neighbors, in the order of their ranks.
    """
    counts = np.array([len(context) - length + 1 for context in contexts])
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    begins = np.cumsum([0, *(len(context) for context in contexts[:-1])])
    owner = np.repeat(np.arange(len(contexts)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.lib.stride_tricks.sliding_window_view(joined, length)[begins[owner] + inner]
    windows = np.ascontiguousarray(rows).view(f"S{length}").reshape(-1)
    by_rank = np.lexsort((inner, order[owner]))
    ranked = by_rank[np.argsort(windows[by_rank], kind="stable")]
    later = np.zeros(len(windows), bool)
    later[ranked[1:]] = windows[ranked[1:]] == windows[ranked[:-1]]
    return np.split(later, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


SPAN = ["doc", "twin", "start", "n"]


def sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows among the first occurrences of different phrases with one trigger."""

    def flush(group):
        contexts = [row[4] for row in group]
        later = equal_windows(contexts, np.arange(len(group)), length)
        return [
            {"doc": row[1], "twin": row[2], "start": row[3] + begin, "n": count}
            for row, flags in zip(group, later)
            for begin, count in _runs(flags)
        ]

    def work(batches):
        group, kinds = [], pa.schema([(name, pa.int64()) for name in SPAN])
        for batch in batches:
            found = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if group and group[0][0] != row[0]:
                    found += flush(group) if len(group) > 1 else []
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_pylist(found, kinds)
        yield pa.RecordBatch.from_pylist(flush(group) if len(group) > 1 else [], kinds)

    dealt = contexts.repartition("h").sortWithinPartitions("h", "doc", "twin", "start")
    return dealt.select("h", "doc", "twin", "start", "data").mapInArrow(work, "doc long, twin long, start long, n long")


def spread_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for triggers with too many phrases for one task: every window by its 128-bit hash."""

    def work(batches):
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            for doc, twin, start, data in zip(*(column.to_pylist() for column in batch.columns)):
                sums = [digest(data[k : k + length]) for k in range(len(data) - length + 1)]
                count = len(sums)
                halves = np.array([(s >> 64, s & (1 << 64) - 1) for s in sums], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(np.full(count, doc)), pa.array(np.full(count, twin)), pa.array(np.arange(start, start + count))],
                    ["w1", "w2", "doc", "twin", "start"],
                )

    rows = contexts.select("doc", "twin", "start", "data").mapInArrow(work, "w1 long, w2 long, doc long, twin long, start long")
    rows = settle(rows)
    place = F.struct("doc", "twin", "start")
    firsts = rows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("count"))
    met = rows.join(settle(firsts.where("count > 1")), ["w1", "w2"]).where(place != F.col("first"))
    return met.select("doc", "twin", "start", F.lit(1).cast("long").alias("n"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, width: int = TRIGGER, group: int = GROUP) -> DataFrame:
    """``doc, twin, start, n``: n windows from start on, each of which also starts earlier."""
    triggers = settle(repeated_triggers(keyed, length, width))
    parse = settle(repeated_phrases(keyed, triggers, length, width))
    place = F.struct("doc", "twin", "start")
    dictionary = settle(
        parse.groupBy("h", "c").agg(F.min(F.struct("doc", "twin", "start", "n")).alias("at"), F.count(F.lit(1)).alias("times"))
    )
    again = dictionary.where("times > 1").select("h", "c", F.struct("at.doc", "at.twin", "at.start").alias("first"))
    later = parse.join(again, ["h", "c"]).where(place != F.col("first")).select(*SPAN)
    later = settle(later)
    sizes = dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("phrases")).where("phrases > 1")
    shared = dictionary.join(sizes, "h").select("h", "at.*", (F.col("phrases") > group).alias("many"))
    lists = settle(shared.groupBy("doc", "twin").agg(F.collect_list(F.struct("h", "start", "n", "many")).alias("places")))
    discard(triggers, parse, dictionary)

    def cut(batches):
        kinds = pa.schema([("h", pa.int64()), ("many", pa.bool_()), ("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = batch.slice(k, 200)
                found = [
                    {"h": p["h"], "many": p["many"], "doc": doc, "twin": twin, "start": p["start"], "data": data[p["start"] : p["start"] + p["n"] + length - 1]}
                    for doc, twin, data, places in zip(*(column.to_pylist() for column in rows.columns))
                    for p in places
                ]
                yield pa.RecordBatch.from_pylist(found, kinds)

    met = keyed.select("doc", "twin", "data").join(lists, ["doc", "twin"]).select("doc", "twin", "data", "places")
    contexts = settle(met.mapInArrow(cut, "h long, many boolean, doc long, twin long, start long, data binary"))
    spans = later.unionByName(sorted_spans(contexts.where("not many"), length))
    if contexts.where("many").limit(1).count():
        spans = spans.unionByName(spread_spans(contexts.where("many"), length))
    return spans


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the bytes without the spans (start, end), and the maximal spans."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    edges = [0, *itertools.chain.from_iterable(merged), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), [tuple(span) for span in merged]


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER, group: int = GROUP) -> DataFrame:
    """Texts without the bytes of repeated strings: doc_id, n_bytes, spans, kept (bytes), kept_sha256.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id
    (null last), or before in the same text. Strings are judged on the input and do not cross
    documents; bytes are UTF-8, null texts empty. Rows with one doc_id are ordered by a hash of
    their text; rows alike in both count as one document and get the same result each. An empty
    table gives an empty result. Other columns are not read.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length, width, group)
    end = F.col("start") + F.col("n") + (length - 1)
    lists = spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", end.alias("end"))).alias("spans"))
    lists = settle(lists)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for data, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    kept, merged = remove_spans(data, [(span["start"], span["end"]) for span in found or ()])
                    rows.append((len(data), [{"start": a, "end": b} for a, b in merged], kept, hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*rows)) or [(), (), (), ()]
                pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                arrays = [pa.array(column, type_) for column, type_ in zip(columns, (pa.int64(), pair, pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    met = keyed.join(lists, ["doc", "twin"], "left").select("doc_id", "data", "spans")
    return met.mapInArrow(work, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")
