"""Find aggregates that need more than a partial and a final sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordered import with_running_sum
from tidemark.operators.skew import HOT_ROWS, join_keys


def count_distinct(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact distinct count: dedupe on (keys, value), then count, so a hot key is spread by its values."""
    return df.select(*keys, value).filter(F.col(value).isNotNull()).distinct().groupBy(*keys).agg(
        F.count("*").alias(out))


def median(df: DataFrame, keys: list[str], value: str, width: float = 1.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median per key, the null key included, without gathering a key's values.

    Values become counts per (keys, value) on the map side. Running counts find the middle
    positions; a key with very many distinct values is split into slices of its value
    range of the given width.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    running = with_running_sum(
        counts, keys, [value], F.floor(F.col(value) / F.lit(width)), "__n", "__upto", hot_rows)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    joined = join_keys(running, totals, keys)
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    holds = lambda p: (F.col("__upto") >= p) & (F.col("__upto") - F.col("__n") < p)
    middle = joined.filter(holds(low) | holds(high))
    # a value that holds both middle positions is one row, otherwise there are two
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median"))
