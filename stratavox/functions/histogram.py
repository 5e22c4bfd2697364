"""Equal-width bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a value between ``low`` and ``high``; the last bin is closed, and 0 where both are equal.

    The quotient may round across an edge, so the bin is set right against the edges
    ``low + i * width`` themselves.
    """
    width = (high - low) / F.lit(bins)
    first = F.least(F.lit(bins - 1), F.floor((value - low) * F.lit(bins) / F.nullif(high - low, F.lit(0.0))))
    upper = F.when(first + 1 >= bins, high).otherwise(low + (first + 1) * width)
    moved = F.when(value < low + first * width, first - 1).when((value >= upper) & (first < bins - 1), first + 1).otherwise(first)
    return F.coalesce(moved, F.lit(0)).cast("int")


def entropy_term(share: Column) -> Column:
    """``-p * log2(p + 1e-10)``."""
    return -share * F.log2(share + F.lit(1e-10))
