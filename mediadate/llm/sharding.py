"""Minimax contiguous sharding: the smallest shard capacity over ordered atomic groups.

Groups stay in the order of their first row. A shard is a run of groups; the capacity is the least
one for which greedy filling needs no more than the wanted shards. It is found by bisection over
running totals; the cuts are then moved towards even ones within that capacity. The totals lie in a table cut into blocks of neighboring groups. The driver holds
one row per block and the running totals of the few blocks in which a cut can fall, at most
``BLOCK_GROUPS`` numbers each.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediadate.llm.common import join_lookup, partitions, settle

BLOCK_GROUPS = 100_000


class RunningTotals:
    """Running totals of group sizes: ``floor(x)`` is the largest total that is not above x."""

    def __init__(self, positions: DataFrame, blocks: list):
        self._positions, self._known = positions, {}
        self._numbers = [row["block"] for row in blocks]
        self._ends = list(itertools.accumulate(row["total"] for row in blocks))
        self.total = self._ends[-1] if blocks else 0
        self.largest = max((row["largest"] for row in blocks), default=0)

    def start(self, index: int) -> int:
        return self._ends[index - 1] if index else 0

    def starts(self) -> list[tuple[int, int]]:
        return [(number, self.start(index)) for index, number in enumerate(self._numbers)]

    def load(self, points: list[int]) -> None:
        """Fetch the blocks that hold these points, all with one job."""
        wanted = {bisect.bisect_right(self._ends, x) for x in points} - self._known.keys()
        wanted = [index for index in wanted if index < len(self._ends)]
        if not wanted:
            return
        index_of = {self._numbers[index]: index for index in wanted}
        rows = self._positions.where(F.col("block").isin(list(index_of))).select("block", "end").collect()
        for index in wanted:
            self._known[index] = []
        for row in rows:
            self._known[index_of[row["block"]]].append(row["end"])
        for index in wanted:
            self._known[index].sort()

    def floor(self, x: int) -> int:
        if x >= self.total:
            return self.total
        index = bisect.bisect_right(self._ends, x)
        self.load([x])
        ends = self._known[index]
        place = bisect.bisect_right(ends, x - self.start(index))
        return self.start(index) + (ends[place - 1] if place else 0)

    def ceiling(self, x: int) -> int:
        """The smallest total that is not below x."""
        below = self.floor(x)
        if below >= x or below >= self.total:
            return below
        index = bisect.bisect_right(self._ends, x)
        ends = self._known[index]
        return self.start(index) + ends[bisect.bisect_right(ends, x - self.start(index))]


def greedy_cuts(totals: RunningTotals, capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards filled up to the capacity; none if they do not hold everything."""
    cuts, end = [], 0
    for _ in range(shards):
        if end < totals.total:
            end = totals.floor(end + capacity)
        cuts.append(end)
    return cuts if end >= totals.total else None


def smallest_capacity(totals: RunningTotals, shards: int) -> tuple[int, list[int]]:
    low = max(totals.largest, -(-totals.total // shards))
    high = low + totals.largest
    totals.load([low * (k + 1) for k in range(shards)])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(totals, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low, even_cuts(totals, low, shards)


def even_cuts(totals: RunningTotals, capacity: int, shards: int) -> list[int]:
    """Cuts of shards within the capacity, each as near to an even cut as the rest allows.

    Filled greedily, all but the last shards would be full. The least end of each shard for which
    the later ones still hold the rest comes from filling backwards.
    """
    least = [totals.total]
    for _ in range(shards - 1):
        least.append(totals.ceiling(max(0, least[-1] - capacity)))
    cuts, end = [], 0
    for k, lowest in enumerate(reversed(least[1:]), start=1):
        even = totals.total * k // shards
        below, above = totals.floor(even), totals.ceiling(even)
        nearest = below if even - below <= above - even else above
        end = max(end, lowest, min(nearest, totals.floor(end + capacity)))
        cuts.append(end)
    return [*cuts, totals.total]


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` and ``place``, the running total at the group's end.

    ``groups`` has ``group`` (unique), ``first`` (its rank in the order, null last) and ``size``.
    No group is split. An empty table gives an empty table.
    """
    spark = groups.sparkSession
    groups = settle(groups.select("group", "first", "size"))
    order = [F.col("first").asc_nulls_last(), F.col("group")]
    count = max(partitions(spark), -(-groups.count() // BLOCK_GROUPS))
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    positions = settle(
        groups.repartitionByRange(count, *order)
        .withColumn("block", F.spark_partition_id())
        .withColumn("end", F.sum("size").over(inside))
        .select("group", "block", "size", "end")
    )
    blocks = positions.groupBy("block").agg(F.sum("size").alias("total"), F.max("size").alias("largest"))
    totals = RunningTotals(positions, blocks.orderBy("block").collect())
    _, cuts = smallest_capacity(totals, shards)
    starts = spark.createDataFrame(totals.starts(), "block int, start long")
    place = F.col("start") + F.col("end")
    shard = sum((F.when(place > cut, 1).otherwise(0) for cut in cuts[:-1]), F.lit(0))
    return positions.join(F.broadcast(starts), "block").select("group", place.alias("place"), shard.alias("shard"))


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``: rows of each shard numbered from 0 without gaps, in the given order.

    Rows are dealt out by ranges of shard and order, so a group of any size covers several ranges;
    each range numbers its own rows, and only counts per range and shard reach the driver.
    """
    spark = rows.sparkSession
    count = max(partitions(spark), 1)
    local = Window.partitionBy("_piece", "shard").orderBy(*order)
    pieces = settle(
        rows.repartitionByRange(count, "shard", *order)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_local", F.row_number().over(local) - 1)
    )
    counted = pieces.groupBy("shard", "_piece").count().orderBy("shard", "_piece").collect()
    starts, shard, before = [], None, 0
    for row in counted:
        before = 0 if row["shard"] != shard else before
        shard = row["shard"]
        starts.append((shard, row["_piece"], before))
        before += row["count"]
    known = spark.createDataFrame(starts, "shard int, _piece int, _start long")
    joined = pieces.join(F.broadcast(known), ["shard", "_piece"])
    return joined.withColumn("slot", F.col("_start") + F.col("_local")).drop("_piece", "_local", "_start")


def shard_documents(docs: DataFrame, shards: int, overhead: int = 8) -> DataFrame:
    """Put documents into shards of nearly equal bytes; equal texts stay together.

    A row weighs its UTF-8 bytes and ``overhead``; a null text has no bytes, and null texts form a
    group of their own. Groups follow the order of their smallest doc_id, null ids last. Repeated
    rows are rows of the same group. Other columns of ``docs`` are not read. Shards can be empty
    if there are fewer groups; a text larger than a shard's share has one to itself. Result: doc_id, size, text_crc32, shard, slot.
    """
    rows = settle(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("group"),
        )
    )
    groups = rows.groupBy("group").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"))
    placed = assign_groups(groups, shards)
    joined = join_lookup(rows, settle(placed), ["group"], "doc_id").drop("group")
    return number_rows(joined, ["place", "doc_id"]).select("doc_id", "size", "text_crc32", "shard", "slot")
