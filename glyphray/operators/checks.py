"""Accounting: nothing may get lost between good rows and rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accounting(source: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows of ``source`` missing from the parts, or surplus in them, with their count difference.

    Multisets are compared by counting, which combines before it shuffles.
    """
    cols = source.columns
    signed = [source.select(*cols, F.lit(1).alias("n"))] + [p.select(*cols, F.lit(-1).alias("n")) for p in parts]
    both = reduce(DataFrame.unionByName, signed)
    return both.groupBy(*cols).agg(F.sum("n").alias("difference")).filter("difference != 0")
