"""Finding hot keys before a shuffle would gather them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# More rows than this and a key is not left to one task.
HOT_ROWS = 1 << 20
# Up to this many hot keys are broadcast; beyond it Spark chooses the join.
BROADCAST_KEYS = 10_000
# Up to this many short rows are broadcast.
BROADCAST_ROWS = 200_000


def join_keys(
    df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", exact: list[str] = ()
) -> DataFrame:
    """Join on ``keys``, where null equals null, and on ``exact``, where it does not; no key comes twice."""
    right = other.select(*[F.col(k).alias(f"__on_{k}") for k in [*keys, *exact]],
                         *[c for c in other.columns if c not in (*keys, *exact)])
    on = [df[k].eqNullSafe(right[f"__on_{k}"]) for k in keys] + [df[k] == right[f"__on_{k}"] for k in exact]
    return df.join(right, reduce(lambda a, b: a & b, on), how).drop(*[f"__on_{k}" for k in [*keys, *exact]])


def hot_counts(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``keys`` and ``__n`` of the keys with more than ``hot_rows`` rows; None when there are none.

    The counts are combined on the map side and read the key columns only. There
    are at most rows / hot_rows hot keys, and the broadcast is decided on their
    actual number.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    first = counts.limit(BROADCAST_KEYS + 1).collect()
    if not first:
        return None
    if len(first) > BROADCAST_KEYS:
        return counts
    return F.broadcast(df.sparkSession.createDataFrame(first, counts.schema))


def mark_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``df`` with ``__hot``, true on rows of hot keys; None when no key is hot."""
    hot = hot_counts(df, keys, hot_rows)
    if hot is None:
        return None
    marks = hot.select(*keys, F.lit(True).alias("__is"))
    return join_keys(df, marks, keys, "left").withColumn(
        "__hot", F.coalesce("__is", F.lit(False))).drop("__is")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows
