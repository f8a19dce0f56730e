"""Stored service payloads and cursor-driven pulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def zip_rows(df: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """Parallel arrays to one row per position; shorter arrays are padded with nulls."""
    named = df
    for out, c in arrays.items():
        named = named.withColumn(out, c)
    rest = [c for c in named.columns if c not in arrays]
    return named.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("__z")).select(
        *rest, *[F.col(f"__z.{out}").alias(out) for out in arrays])


@dataclass(frozen=True)
class Cursor:
    """What is still to be pulled: rows above ``since`` and, on the way down, below ``until``.

    ``top`` is the highest cursor seen on the way down, where the next way starts from.
    """

    since: int
    until: int | None = None
    top: int | None = None


def incremental_pull(
    df: DataFrame, cursor: str, at: int | Cursor, take_n: int = 50, descending: bool = False
) -> DataFrame:
    """The next ``take_n`` rows of a cursor's range, lowest or highest first; ``cursor`` must be unique."""
    at = at if isinstance(at, Cursor) else Cursor(at)
    order = F.col(cursor).desc() if descending else F.col(cursor)
    left = df.filter(F.col(cursor) > at.since)
    if at.until is not None:
        left = left.filter(F.col(cursor) < at.until)
    return left.orderBy(order).limit(take_n)


def next_cursor(
    pulled: DataFrame, cursor: str, at: int | Cursor, take_n: int = 50, descending: bool = False
) -> Cursor:
    """Where to pull from next time; no row is ever passed over.

    A descending pull goes on below its lowest row until a pull comes back short; only
    then does the range start anew above the highest row seen.
    """
    at = at if isinstance(at, Cursor) else Cursor(at)
    n, low, high = pulled.agg(F.count("*"), F.min(cursor), F.max(cursor)).first()
    top = max(x for x in (at.since, at.top, high) if x is not None)
    if descending and n >= take_n:
        return Cursor(at.since, low, top)
    return Cursor(top)


def start_cursor(df: DataFrame, cursor: str, received: str, since) -> int:
    """Cursor just before the first row received after an instant."""
    first = df.filter(F.col(received) > F.lit(since)).agg(F.min(cursor)).first()[0]
    return 0 if first is None else first - 1
