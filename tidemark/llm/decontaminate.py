"""Benchmark decontamination by Wu-Manber search over words.

Test items are cut into windows of ten consecutive words; an item of fewer words is
one window. The symbols of the search are whole words. For all windows of one
length m the SHIFT table says, for a block of two consecutive words, how far the
search may jump: a block that no window holds skips m - 1 words at once. A block
that ends some window leads to the bucket of windows with that suffix and, in it,
to those that start with the right word; comparing the words confirms each place.

The windows go to the tasks in blocks of at most ``block_windows``: repeated rows are
made one, long items are cut into overlapping parts, and a running sum of windows
says which block a part belongs to. Documents of a later block pass through a written table, so that no task holds two blocks.

Null and empty texts have no words and are never hit. Items without words have no
window. Items with a null id hit words but are not listed. Repeated items and
windows that several items share name every such item once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import alnum_words, bounded_batches, bytes_of
from tidemark.session import cut

WINDOW = 10
BLOCK_WINDOWS = 200_000


class WuManber:
    """Finds windows, all of ``m`` words, in lists of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for window, items in windows.items():
            for end in range(self.block, m + 1):
                block = window[end - self.block:end]
                self.shift[block] = min(m - end, self.shift.get(block, m))
            self.bucket.setdefault(window[m - self.block:], {}).setdefault(window[0], []).append((window, items))
        self.skip = m - self.block + 1

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of each place where a window stands."""
        m, shift, skip, end, n = self.m, self.shift.get, self.skip, self.m, len(words)
        while end <= n:
            block = tuple(words[end - self.block:end])
            step = shift(block, skip)
            if step:
                end += step
                continue
            start = end - m
            for window, items in self.bucket[block].get(words[start], ()):
                if window == tuple(words[start:end]):
                    yield start, items
            end += 1


def windows_of(data: bytes | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = alnum_words(data)
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]


def searchers(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, data in items:
        for w in windows_of(data, window):
            named = by_length.setdefault(len(w), {}).setdefault(w, [])
            if item is not None and item not in named:
                named.append(item)
    return [WuManber(ws, m) for m, ws in sorted(by_length.items())]


def hits(words: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal runs of hit words as (first, last), and the items that occur."""
    places: list[tuple[int, int]] = []
    items: set[str] = set()
    for s in found:
        for start, named in s.search(words):
            places.append((start, start + s.m - 1))
            items.update(named)
    runs: list[tuple[int, int]] = []
    for first, last in sorted(places):
        if runs and first <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(runs[-1][1], last))
        else:
            runs.append((first, last))
    return runs, items


def _searched(data: Column, items: list[tuple[str | None, bytes | None]], window: int) -> Column:
    @F.pandas_udf("n_words bigint, firsts array<bigint>, lasts array<bigint>, items array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = searchers(items, window)
        for batch in batches:
            rows = []
            for text in batch:
                words = alnum_words(text)
                runs, named = hits(words, found)
                rows.append((len(words), [r[0] for r in runs], [r[1] for r in runs], sorted(named)))
            yield pd.DataFrame(rows, columns=["n_words", "firsts", "lasts", "items"])

    return search(data)


def _parts(items: DataFrame, window: int, block_windows: int) -> DataFrame:
    """Distinct items in parts of at most a quarter of a block, with the block each belongs to."""
    most = max(1, block_windows // 4)
    # a part ends in its block, and up to most - 1 of its windows may count for the block before
    step = block_windows - most + 1

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for item, data in zip(batch["item"], batch["data"]):
                words = alnum_words(data)
                windows = max(1, len(words) - window + 1) if words else 0
                for low in range(0, windows, most):
                    n = min(most, windows - low)
                    upto += n
                    rows.append((item, b" ".join(words[low:low + n + window - 1]), task, upto))
            yield pd.DataFrame(rows, columns=["item", "data", "task", "upto"])

    parts = cut(items.distinct().mapInPandas(cut_up, "item string, data binary, task int, upto bigint"))
    # a row per task
    before, sums = 0, []
    for r in parts.groupBy("task").agg(F.max("upto").alias("n")).orderBy("task").collect():
        sums.append((r.task, before))
        before += r.n
    offsets = items.sparkSession.createDataFrame(sums, "task int, before bigint")
    return cut(parts.join(offsets, "task").select(
        "item", "data", F.floor((F.col("before") + F.col("upto") - 1) / step).cast("bigint").alias("block")))


def _block(parts: DataFrame, k: int) -> list[tuple[str | None, bytes]]:
    """The parts of one block; only one block at a time is on the driver."""
    return [(r.item, bytes(r.data)) for r in parts.filter(F.col("block") == k).collect()]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, into: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, spans (runs of hit words as first and last), items.

    All other columns stay, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), bytes_of(item_text).alias("data")).filter("data is not null")
    parts = _parts(items, window, block_windows)
    n = 1 + (parts.agg(F.max("block")).first()[0] or 0)
    # columns of documents may have any name, so they stay in one
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    data = F.col("row").getField(text).cast("binary")
    out = rows.select("row", _searched(data, _block(parts, 0), window).alias("found"))
    for k in range(1, n):
        # what the block before has found is written before the next one is gathered
        out = cut(out).select("row", "found", _searched(data, _block(parts, k), window).alias("now")).select("row", F.struct(
            "found.n_words", *[F.concat(f"found.{c}", f"now.{c}").alias(c) for c in ("firsts", "lasts")],
            F.array_union("found.items", "now.items").alias("items")).alias("found"))
    pairs = F.arrays_zip(F.col("found.firsts").alias("first"), F.col("found.lasts").alias("last"))
    if n > 1:
        pairs = _joined(pairs)
    found = F.struct("found.n_words", pairs.alias("spans"), F.array_sort("found.items").alias("items"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != into], found.alias(into))


def _joined(pairs: Column) -> Column:
    """Runs of several searches as maximal runs."""
    kind = "array<struct<first:bigint,last:bigint>>"
    return F.aggregate(F.array_sort(pairs), F.array().cast(kind), lambda runs, x: F.when(
        (F.size(runs) > 0) & (x["first"] <= F.element_at(runs, -1)["last"] + 1),
        F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
            F.element_at(runs, -1)["first"].alias("first"),
            F.greatest(F.element_at(runs, -1)["last"], x["last"]).alias("last"))))
    ).otherwise(F.concat(runs, F.array(x))))


def n_hit(into: str = "contamination") -> Column:
    """The number of hit words."""
    return F.aggregate(f"{into}.spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"] + 1)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no window of a test item occurs in, with their own columns."""
    found = find(docs, benchmark, into="__contamination", **options)
    return found.filter(F.size("__contamination.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
