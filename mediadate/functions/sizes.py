"""Readable byte counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, each 1024 times the one before.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_size(num_bytes: Column) -> Column:
    """Byte count with one decimal in the largest unit below 1024."""
    size = num_bytes.cast("double")
    text = None
    for power, unit in enumerate(UNITS):
        # Powers of 1024 divide exactly, so rounding half to even first leaves nothing to round.
        shown = F.format_string("%.1f" + unit, F.bround(size / float(1024**power), 1))
        if unit == UNITS[-1]:
            return text.when(size.isNotNull(), shown)
        fits = size < float(1024 ** (power + 1))
        text = F.when(fits, shown) if text is None else text.when(fits, shown)
