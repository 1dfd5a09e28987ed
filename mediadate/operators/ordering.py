"""Running totals that no single hot key can pile onto one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20


def running_total(
    rows: DataFrame, keys: list[str], position: str, value: str, name: str, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier positions of the same keys.

    ``position`` is a long. Rows are summed inside blocks of positions, blocks inside larger blocks,
    and the totals are carried down again. Each window sees at most ``2 ** block_bits`` positions,
    however many rows a key has, and the blocks are sums that Spark pre-aggregates map-side.
    """
    small, large = f"_{name}_small", f"_{name}_large"
    inside, middle, outer = f"_{name}_inside", f"_{name}_middle", f"_{name}_outer"
    rows = rows.withColumn(small, F.shiftright(F.col(position), block_bits))
    blocks = rows.groupBy(*keys, small).agg(F.sum(value).alias("_sum"))
    blocks = blocks.withColumn(large, F.shiftright(F.col(small), block_bits))
    groups = blocks.groupBy(*keys, large).agg(F.sum("_sum").alias("_sum"))

    def before(partition, order, column):
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    groups = groups.withColumn(outer, before(keys, large, "_sum")).drop("_sum")
    blocks = blocks.withColumn(middle, before([*keys, large], small, "_sum")).drop("_sum")
    blocks = blocks.join(groups, [*keys, large]).select(*keys, small, (F.col(middle) + F.col(outer)).alias(middle))
    rows = rows.withColumn(inside, before([*keys, small], position, value))
    return (
        rows.join(blocks, [*keys, small])
        .withColumn(name, (F.col(inside) + F.col(middle)).cast("long"))
        .drop(small, inside, middle)
    )
