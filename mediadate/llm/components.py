"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import discard, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of an edge ``a, b``; the root is the component's smallest node.

    Each node hooks to its smallest neighbor (a minimum, combined before the shuffle); pointers are
    doubled until they meet roots; edges are redrawn between roots until none is left. The number
    of rounds grows with the logarithm of the longest chain. Written tables cut the lineage, and
    the driver only learns whether rows are left. Self edges and repeated edges do no harm.
    """
    edges = settle(edges.where("a is not null and b is not null").select("a", "b").distinct())
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        pointers = settle(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        pointers = _jump(pointers)
        if labels is None:
            labels = pointers
        else:
            step = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            labels = settle(labels.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        one = pointers.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        two = pointers.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        redrawn = edges.join(one, "a").join(two, "b").where("_a <> _b")
        redrawn = settle(redrawn.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        discard(edges)
        edges = redrawn
        if edges.limit(1).count() == 0:
            return labels


def _jump(pointers: DataFrame) -> DataFrame:
    while True:
        above = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = settle(pointers.join(above, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")))
        if moved.where("moved").limit(1).count() == 0:
            return moved.select("node", "root")
        settled, pointers = moved.settled, moved.select("node", "root")
        pointers.settled = settled
