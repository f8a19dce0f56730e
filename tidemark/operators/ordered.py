"""Ordered computations (next, previous, carry forward, running sum) that survive hot keys.

A plain window puts all rows of one key into one task. That is the best plan for
ordinary keys: one shuffle. A key with more than ``HOT_ROWS`` rows is cut into
buckets instead: the caller names a ``bucket`` that grows with the order, such as
``tx_id div 2**20``, so a hot key's rows in one bucket are few however many it has
in all. The window then runs within (key, bucket), and what has to cross a bucket
border comes from one summary row per (hot key, bucket), joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.skew import HOT_ROWS, join_keys, mark_hot

# A key has at most one version per transaction, so this bounds a bucket's rows.
TX_SPAN = 1 << 20


def tx_bucket(tx_id: Column, span: int = TX_SPAN) -> Column:
    return F.floor(tx_id / F.lit(span))


def _order(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _bucketed(df: DataFrame, keys: list[str], bucket: Column, hot_rows: int) -> DataFrame | None:
    """``df`` with ``__hot`` and ``__bucket`` (null on ordinary keys); None when no key is hot."""
    marked = mark_hot(df, keys, hot_rows)
    if marked is None:
        return None
    return marked.withColumn("__bucket", F.when(F.col("__hot"), bucket.cast("bigint")))


def with_next(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add, for each ``out: source`` of ``values``, the value of the key's next row (null at the end)."""
    return _neighbour(df, keys, order, bucket, values, hot_rows, ahead=True)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add, for each ``out: source`` of ``values``, the value of the key's previous row."""
    return _neighbour(df, keys, order, bucket, values, hot_rows, ahead=False)


def _neighbour(df, keys, order, bucket, values, hot_rows, ahead: bool) -> DataFrame:
    shift = F.lead if ahead else F.lag
    cut = _bucketed(df, keys, bucket, hot_rows)
    if cut is None:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[shift(src).over(w).alias(out) for out, src in values.items()])
    payload = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order)
    across = W.partitionBy(*keys).orderBy("__bucket")
    edge = F.min_by if ahead else F.max_by
    edges = cut.filter("__hot").groupBy(*keys, "__bucket").agg(edge(payload, _order(order)).alias("__edge"))
    edges = edges.select(*keys, "__bucket", shift("__edge").over(across).alias("__beyond"))
    near = cut.withColumn("__near", shift(payload).over(inside))
    found = F.coalesce("__near", "__beyond")
    return join_keys(near, edges, keys, "left", ["__bucket"]).withColumn("__near", found).select(
        *df.columns, *[F.col(f"__near.{o}").alias(o) for o in values])


def with_carried(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` of the key up to and including each row."""
    cut = _bucketed(df, keys, bucket, hot_rows)
    if cut is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    latest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), _order(order)))
    tails = cut.filter("__hot").groupBy(*keys, "__bucket").agg(latest.alias("__tail"))
    tails = tails.select(
        *keys, "__bucket", F.last("__tail", ignorenulls=True).over(across).alias("__before"))
    near = cut.withColumn("__near", F.last(value, ignorenulls=True).over(inside))
    return join_keys(near, tails, keys, "left", ["__bucket"]).select(
        *df.columns, F.coalesce("__near", "__before").alias(out))


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the key's running sum of ``value`` up to and including each row."""
    return with_running_sums(df, keys, order, bucket, {out: value}, hot_rows)


def with_running_sums(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add, for each ``out: source`` of ``values``, the key's running sum of the source: all in one window."""
    cut = _bucketed(df, keys, bucket, hot_rows)
    if cut is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(src).over(w).alias(out) for out, src in values.items()])
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.filter("__hot").groupBy(*keys, "__bucket").agg(*[F.sum(src).alias(f"__s_{out}") for out, src in values.items()])
    sums = sums.select(*keys, "__bucket", *[F.sum(f"__s_{out}").over(across).alias(f"__before_{out}") for out in values])
    near = cut.select("*", *[F.sum(src).over(inside).alias(f"__near_{out}") for out, src in values.items()])
    return join_keys(near, sums, keys, "left", ["__bucket"]).select(*df.columns, *[
        (F.col(f"__near_{out}") + F.coalesce(f"__before_{out}", F.lit(0))).alias(out) for out in values])
