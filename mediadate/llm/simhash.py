"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of a covering code: products of perfect Hamming codes and free bits. A
fingerprint's home is its nearest anchor, at distance r. It is also copied to every anchor within
r + t, t the threshold. Of two fingerprints that differ in at most t bits, let x be the one nearer
to its home h; then the other, y, lies within r(x) + t <= r(y) + t of h and was copied there. So
comparing an anchor's homes with all that was copied to it finds every link.

The 64 bits are covered in parts: of k parts at least one differs in no more than t // k bits. With
three parts an anchor takes 2**-15 of all fingerprints and each has 33 copies or fewer; with two
parts it is 2**-24 and about 300 copies, which pays from some ten million fingerprints on. Both
find exactly the same links; ``anchor_parts`` chooses by their number.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import LOWER, UPPER, join_lookup, remembered, settle
from mediadate.llm.components import connected_components

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
MANY = 1 << 25
TILE = 1 << 15
CELLS = 1 << 21

# Blocks of the parts, lowest bits first: (bits, whether a Hamming code covers them).
THREE_PARTS = (((15, True), (7, True)), ((15, True), (6, False)), ((15, True), (6, False)))
TWO_PARTS = (((15, True), (15, True), (2, False)),) * 2


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of the lower-cased text's word shingles, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(word) + 1 for word in words))
    starts = [0, *ends[: max(0, len(words) - shingle)]]
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, last)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for block in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[block : block + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def add_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash and fingerprint (long) of every row; null texts have no words."""

    def work(batches):
        for batch in batches:
            values = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, text_hash long, fingerprint long")


@remembered
def _syndromes(bits: int) -> np.ndarray:
    """Exclusive or of the positions (from 1) of the set bits, for every value of a block."""
    table = np.zeros(1 << bits, np.int64)
    for k in range(bits):
        table[1 << k : 2 << k] = table[: 1 << k] ^ (k + 1)
    return table


@remembered
def _flips(bits: int, covered: bool, slack: int) -> list[list[tuple[int, int]]]:
    """Per syndrome: the flips (mask, weight) that reach an anchor, up to ``slack`` beyond the nearest."""
    found: list[list[tuple[int, int]]] = [[] for _ in range(bits + 1 if covered else 1)]
    for weight in range(slack + 1 + covered):
        for places in itertools.combinations(range(bits), weight):
            syndrome = functools.reduce(lambda s, k: s ^ (k + 1), places, 0) if covered else 0
            found[syndrome].append((sum(1 << k for k in places), weight))
    return [[flip for flip in flips if flip[1] <= flips[0][1] + slack] for flips in found]


@remembered
def part_table(part: tuple, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and their distance beyond the nearest anchor, by the part's joint syndrome; 255: none."""
    rows = []
    for flips in itertools.product(*(_flips(bits, covered, slack) for bits, covered in part)):
        joint = []
        for choice in itertools.product(*flips):
            mask, shift = 0, 0
            for (bits, _), (own, _) in zip(part, choice):
                mask, shift = mask | own << shift, shift + bits
            joint.append((mask, sum(weight for _, weight in choice)))
        nearest = min(weight for _, weight in joint)
        rows.append([(mask, weight - nearest) for mask, weight in joint if weight - nearest <= slack])
    width = max(map(len, rows))
    masks, beyond = np.zeros((len(rows), width), np.int64), np.full((len(rows), width), 255, np.uint8)
    for k, row in enumerate(rows):
        masks[k, : len(row)], beyond[k, : len(row)] = zip(*row)
    return masks, beyond


def anchor_copies(values: np.ndarray, parts: tuple, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, index of the value, and whether the anchor is its home, for every copy."""
    anchors, owners, homes, shift = [], [], [], 0
    for number, part in enumerate(parts):
        width = sum(bits for bits, _ in part)
        own = (values.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        shift += width
        joint, low = np.zeros(len(own), np.int64), 0
        for bits, covered in part:
            block = (own >> low) & ((1 << bits) - 1)
            low += bits
            joint = joint * (bits + 1) + _syndromes(bits)[block] if covered else joint
        masks, beyond = part_table(part, distance // len(parts))
        row, column = np.nonzero(beyond[joint] != 255)
        anchors.append((number << 33) | (own[row] ^ masks[joint[row], column]))
        owners.append(row)
        homes.append(beyond[joint[row], column] == 0)
    return np.concatenate(anchors), np.concatenate(owners), np.concatenate(homes)


def anchor_parts(count: int) -> tuple:
    return THREE_PARTS if count < MANY else TWO_PARTS


def bucket_links(homes: np.ndarray, members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within a bucket: every linked value with its smallest one."""
    values, places = np.unique(np.concatenate([homes, members]), return_inverse=True)
    own, other = places[: len(homes)], places[len(homes) :]
    labels = np.arange(len(values))
    step = max(1, CELLS // max(1, len(members)))
    for k in range(0, len(homes), step):
        differing = homes[k : k + step, None].view(np.uint64) ^ members[None, :].view(np.uint64)
        near = np.bitwise_count(differing) <= distance
        row, column = np.nonzero(near)
        a, b = own[row + k], other[column]
        a, b = a[a != b], b[a != b]
        while len(a):
            low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
            apart = low != high
            if not apart.any():
                break
            np.minimum.at(labels, high[apart], low[apart])
            while True:
                jumped = labels[labels]
                if (jumped == labels).all():
                    break
                labels = jumped
            a, b = a[apart], b[apart]
    linked = np.nonzero(labels != np.arange(len(values)))[0]
    return values[linked], values[labels[linked]]


def fingerprint_links(fingerprints: DataFrame, distance: int) -> DataFrame:
    """``a, b``: links that connect distinct fingerprints exactly as all links within the distance do.

    A bucket is read as a run of sorted rows. One of more than 2**15 copies is cut into tiles of
    homes and members, each a run of its own, so no task gets it whole; the list of such anchors
    comes from counts that are combined before the shuffle.
    """
    parts = anchor_parts(fingerprints.count())

    def copies(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(values), 4096):
                anchors, owners, homes = anchor_copies(values[k : k + 4096], parts, distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors), pa.array(values[k : k + 4096][owners]), pa.array(homes.astype(np.int8))],
                    ["anchor", "fingerprint", "role"],
                )

    rows = fingerprints.mapInArrow(copies, "anchor long, fingerprint long, role byte")
    large = settle(rows.groupBy("anchor").count().where(F.col("count") > TILE))
    if large.limit(1).count() == 0:
        tiled = rows.withColumn("tile", F.lit(0))
    else:
        tiled = _tiles(rows, large)

    def compare(batches):
        held = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            held = columns if held is None else [np.concatenate(pair) for pair in zip(held, columns)]
            runs = np.nonzero((held[0][1:] != held[0][:-1]) | (held[3][1:] != held[3][:-1]))[0] + 1
            if len(runs):
                yield from _compare_runs([column[: runs[-1]] for column in held], runs[:-1], distance)
                held = [column[runs[-1] :] for column in held]
        if held is not None:
            yield from _compare_runs(held, np.array([], np.int64), distance)

    dealt = tiled.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile")
    return dealt.select("anchor", "fingerprint", "role", "tile").mapInArrow(compare, "a long, b long")


def _tiles(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of large buckets once per tile: role 2 as a home, 0 as a member; others as they are."""
    sides = F.ceil(F.col("count") / TILE).cast("int")
    met = join_lookup(rows, large.withColumn("sides", sides).drop("count"), ["anchor"], "fingerprint", "left")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("sides")).cast("int")
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    as_member = F.transform(every, lambda k: F.struct((k * F.col("sides") + own).alias("tile"), F.lit(0).cast("byte").alias("role")))
    as_home = F.transform(every, lambda k: F.struct((own * F.col("sides") + k).alias("tile"), F.lit(2).cast("byte").alias("role")))
    alone = F.array(F.struct(F.lit(0).alias("tile"), F.col("role").alias("role")))
    places = F.when(F.col("sides").isNull(), alone).when(F.col("role") == 1, F.concat(as_member, as_home)).otherwise(as_member)
    return met.withColumn("place", F.explode(places)).select("anchor", "fingerprint", F.col("place.role").alias("role"), F.col("place.tile").alias("tile"))


def _compare_runs(columns, runs, distance):
    _, values, roles, _ = columns
    found = []
    for start, end in itertools.pairwise([0, *runs.tolist(), len(values)]):
        if end - start < 2:
            continue
        own, role = values[start:end], roles[start:end]
        homes = own[role > 0]
        if len(homes):
            members = own[role < 2]
            a, b = bucket_links(homes, members, distance)
            if len(a):
                found.append((a, b))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found)], ["a", "b"])


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, text_hash, fingerprint (long), component_id and component_text of every row.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id
    that links reach, component_text the hash of its text. Rows with one fingerprint are one node, however many they are. Texts without
    words and null texts have fingerprint 0 and link like any other. Null doc_ids are rows like
    others, but only name a component that has no other. Repeated rows stay repeated; an empty
    table gives an empty result. Very long texts count whole. Other columns are not read.
    """
    rows = settle(add_fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash"))
    nodes = settle(rows.groupBy("fingerprint").agg(first.alias("first")))
    links = fingerprint_links(nodes.select("fingerprint"), distance)
    roots = connected_components(links).select(F.col("node").alias("fingerprint"), "root")
    known = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    known = settle(known)
    named = known.groupBy("root").agg(F.min("first").alias("first"))
    names = [F.col("named.doc_id").alias("component_id"), F.col("named.text_hash").alias("component_text")]
    labeled = known.join(named.withColumnRenamed("first", "named"), "root").select("fingerprint", *names)
    return join_lookup(rows, settle(labeled), ["fingerprint"], "doc_id")


def keep_one_of_each_group(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near fingerprints."""
    return keep_named(docs, near_duplicate_groups(docs, shingle, distance))


def keep_named(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns.

    That is the row with the smallest doc_id, of equal ids the one with the smallest text hash, of
    rows equal in both any one. The others are told by doc_id and text and taken out.
    """
    groups = settle(groups)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_text"))
    others = groups.where(~stays).select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_hash")).distinct()
    others = settle(others)
    same = docs["doc_id"].eqNullSafe(others["_doc_id"]) & (F.xxhash64(docs["text"]) == others["_hash"])
    kept = docs.join(others, same, "left_anti")
    repeated = groups.where(stays).groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
