"""Repeated passages, by blockwise suffix sorting with a difference cover.

A byte is repeated when some string of ``LENGTH`` bytes that covers it starts at
another place too, in the same or another document. To find these starts, suffixes
are sorted to the depth of ``LENGTH`` bytes; equal neighbours are repeats. All
suffixes of a corpus do not fit any machine, so they are cut into *suffix buckets*,
sorted one at a time:

* The bucket of a suffix is the smallest hash among the ``GRAM``-byte strings within
  its first ``LENGTH`` bytes (the leftmost, if equal). It depends on these bytes only, so equal
  strings are in one bucket. Consecutive suffixes share buckets in runs, and a run
  travels as its *region*, the bytes its suffixes cover. Buckets with a single run
  hold no repeats and are never sent; equal regions are made one beforehand.
* Within a bucket, suffixes are first sorted by ``STEP`` bytes. Ties, which are long
  where texts repeat, are resolved by ranks precomputed for the positions of a
  difference cover modulo ``STEP``: for any two positions some common distance below
  ``STEP`` leads to cover positions of both, whose ranks decide about the next
  ``LENGTH - STEP`` bytes; the last ``STEP`` bytes have ranks again. So memory is a
  few numbers per byte of the bucket, whatever the length of the ties.
* A bucket with more than ``HOT_RUNS`` runs, or more than ``HOT_BYTES`` bytes of
  different regions, is not sent to a task: each of its suffixes goes by the digest of
  its ``LENGTH`` bytes instead and is counted.

Texts that occur several times are handled once: if they have ``LENGTH`` bytes, all
of them is repeated. Null and empty texts have no bytes, shorter texts no repeats.
Ids may repeat or be null; a row that is there twice is a copy of itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import tidy
from tidemark.session import cut

LENGTH = 400
GRAM = 32
STEP = 16
# Every difference modulo STEP is one of two of these.
COVER = (0, 1, 2, 5, 8)
HOT_RUNS = 20_000
# Sorting takes about 60 times as much, and a task that holds a bucket may hold the next batch as well.
HOT_BYTES = 1 << 21
AT_ONCE = 1 << 19
BUCKET_BYTES = 1 << 19

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
# DISTANCE[i, j]: leads from residues i and j to cover positions of both.
DISTANCE = np.array([[next(d for d in range(STEP) if (i + d) % STEP in COVER and (j + d) % STEP in COVER) for j in range(STEP)]
                     for i in range(STEP)])
ORDINAL = np.array([COVER.index(i) if i in COVER else -1 for i in range(STEP)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


UP, DOWN = _powers(AT_ONCE + 4096)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A well-mixed hash of each ``gram``-byte string; ``data`` has at most len(UP) bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * UP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * DOWN[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs_of(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one bucket: (bucket, first, last). ``valid`` marks the starts that count."""
    h = gram_hashes(data, gram)
    wide = length - gram + 1
    # the smallest hash, then the leftmost place
    packed = (h & np.uint64(MASK ^ ((1 << 21) - 1))) | np.arange(len(h), dtype=np.uint64)
    n = len(data) - length + 1
    rows = -(-len(packed) // wide)
    grid = np.full(rows * wide, MASK, np.uint64)
    grid[:len(packed)] = packed
    grid = grid.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = np.minimum(behind[:n], ahead[wide - 1:wide - 1 + n]) & np.uint64((1 << 21) - 1)
    starts = np.flatnonzero(valid[:n])
    if not len(starts):
        return np.zeros(0, np.int64), starts, starts
    place = place[starts].astype(np.int64)
    edge = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    low = np.concatenate([[0], edge])
    high = np.concatenate([edge, [len(starts)]]) - 1
    return h[place[low]].view(np.int64), starts[low], starts[high]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a buffer of texts to be handled at once: (from, to, texts, their borders)."""
    k, n = 0, len(offsets) - 1
    while k < n:
        if offsets[k + 1] - offsets[k] > AT_ONCE:
            for low in range(offsets[k], offsets[k + 1] - length + 1, AT_ONCE - length + 1):
                yield low, min(low + AT_ONCE, offsets[k + 1]), np.array([k]), np.array([low, min(low + AT_ONCE, offsets[k + 1])])
            k += 1
            continue
        high = int(np.searchsorted(offsets, offsets[k] + AT_ONCE, side="right")) - 1
        yield offsets[k], offsets[high], np.arange(k, high), offsets[k:high + 1]
        k = high


def sketch_batch(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of the texts of a batch: (text, bucket, first, last), sorted by text; places count within the text."""
    parts = []
    for low, high, texts, borders in _pieces(offsets, length):
        if high - low < length:
            continue
        valid = np.zeros(high - low, bool)
        for a, b in zip(borders[:-1] - low, borders[1:] - low):
            if b - a >= length:
                valid[a:b - length + 1] = True
        bucket, first, last = runs_of(data[low:high], valid, length, gram)
        of = texts[np.searchsorted(borders - low, first, side="right") - 1]
        begin = offsets[of] - low
        parts.append((of, bucket, first - begin, last - begin))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the borders of a column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _sketch(length: int, gram: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _binary(batch.column(2))
            of, bucket, first, last = sketch_batch(data, offsets, length, gram)
            ends = pa.array(np.searchsorted(of, np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (bucket, first, last)]
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, *lists],
                                             ["id", "key", "n_bytes", "buckets", "firsts", "lasts"])

    return sketch


def _regions(length: int):
    """Rows (bucket, region, digest, key, firsts); a suffix of a hot bucket has only its digest."""
    names = ["bucket", "region", "digest", "key", "firsts"]

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for key, data, runs in zip(batch["key"], batch["data"], batch["runs"]):
                own: dict[bytes, list[int]] = {}
                buckets: dict[bytes, int] = {}
                for run in runs:
                    first, last = run["first"], run["last"]
                    if run["hot"]:
                        for p in range(first, last + 1):
                            own.setdefault(hashlib.md5(data[p:p + length]).digest(), []).append(p)
                    else:
                        region = data[first:last + length]
                        own.setdefault(region, []).append(first)
                        buckets[region] = run["bucket"]
                for x, firsts in own.items():
                    if x in buckets:
                        rows.append((buckets[x], x, hashlib.md5(x).digest(), key, firsts))
                    else:
                        rows.append((None, None, x, key, firsts))
                    size += len(x) + 64
                if size > BUCKET_BYTES:
                    yield _frame(rows, names)
                    rows, size = [], 0
            if rows:
                yield _frame(rows, names)

    def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
        # not through a float, which rounds the buckets of a batch that has rows without one
        out = pd.DataFrame(rows, columns=columns, dtype=object)
        out["bucket"] = pd.array([r[0] for r in rows], dtype="Int64")
        return out

    return regions


def dense(high: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Ranks of numbers, or of pairs of ranks, from 0."""
    key = high if low is None else (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    order = np.argsort(key)
    placed = key[order]
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.concatenate([[0], placed[1:] != placed[:-1]]), dtype=np.uint32)
    return rank


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """``x`` from ``by`` on, filled up with its last element; the fill is never decisive."""
    return np.concatenate([x[by:], np.full(min(by, len(x)), x[-1], x.dtype)])


class Sorter:
    """Suffixes of a buffer, compared to the depth of ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        rest = length - STEP
        if rest < STEP or rest % STEP:
            raise ValueError(f"length must be a multiple of {STEP} and at least {2 * STEP}")
        n = -(-len(data) // STEP) * STEP
        padded = np.zeros(n + 8, np.uint64)
        padded[:len(data)] = data
        eight = np.zeros(n, np.uint64)
        for k in range(8):
            eight |= padded[k:n + k] << np.uint64(56 - 8 * k)
        r8 = dense(eight)
        del padded, eight
        self.near = dense(r8, shifted(r8, 8))
        # ranks of cover positions; the one STEP bytes further is len(COVER) entries further
        cover = np.flatnonzero(ORDINAL[np.arange(STEP)] >= 0)
        at = (np.arange(0, n, STEP)[:, None] + cover[None, :]).ravel()
        known = {1: self.near[at]}
        size = 1
        while 2 * size <= rest // STEP:
            known[2 * size] = dense(known[size], shifted(known[size], size * len(COVER)))
            size *= 2
        far, done = known[size], size
        while done < rest // STEP:
            size = max(s for s in known if s <= rest // STEP - done)
            far = dense(far, shifted(known[size], done * len(COVER)))
            done += size
        self.far, self.rest = far, rest

    def compare(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Signs of the comparisons of suffixes that agree in their first STEP bytes."""
        d = DISTANCE[p % STEP, q % STEP]
        rank = lambda x: self.far[(x + d) // STEP * len(COVER) + ORDINAL[(x + d) % STEP]].astype(np.int64)
        sign = np.sign(rank(p) - rank(q))
        same = sign == 0
        sign[same] = np.sign(self.near[p[same] + self.rest].astype(np.int64) - self.near[q[same] + self.rest])
        return sign

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """The starts whose first ``length`` bytes another start has too."""
        group = self.near[starts].astype(np.int64)
        order = np.argsort(group, kind="stable")
        starts, group = starts[order], group[order]
        found = []
        while len(starts):
            edge = np.flatnonzero(np.diff(group)) + 1
            low = np.concatenate([[0], edge])
            size = np.diff(np.concatenate([low, [len(starts)]]))
            keep = np.repeat(size > 1, size)
            low, size, starts = low[size > 1], size[size > 1], starts[keep]
            if not len(starts):
                break
            number = np.repeat(np.arange(len(size)), size)
            # three parts around a pivot: smaller, equal (done), larger
            pivot = starts[(np.cumsum(size) - size + size // 2)[number]]
            sign = self.compare(starts, pivot)
            equal = sign == 0
            many = np.bincount(number[equal], minlength=len(size)) > 1
            found.append(starts[equal & many[number]])
            starts, group = starts[~equal], (2 * number + (sign > 0))[~equal]
            order = np.argsort(group, kind="stable")
            starts, group = starts[order], group[order]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def repeated_ranges(regions: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, first, last) of the runs of repeated starts in regions, which differ from each other."""
    data = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.array([len(r) for r in regions])
    begin = np.cumsum(sizes) - sizes
    valid = np.ones(len(data), bool)
    for a, n in zip(begin, sizes):
        valid[a + n - length + 1:a + n] = False
    hit = Sorter(data, length).repeated(np.flatnonzero(valid))
    if not len(hit):
        return hit, hit, hit
    edge = np.flatnonzero(np.diff(hit) != 1) + 1
    first, last = hit[np.concatenate([[0], edge])], hit[np.concatenate([edge, [len(hit)]]) - 1]
    of = np.searchsorted(begin, first, side="right") - 1
    return of, first - begin[of], last - begin[of]


def _sorted_buckets(length: int):
    """Whole buckets, as they come sorted, are gathered up to BUCKET_BYTES and sorted."""
    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            of, first, last = repeated_ranges([bytes(r) for r in frame["region"]], length)
            out = pd.DataFrame({"digest": frame["digest"].to_numpy()[of], "a": first, "b": last})
            return out[~frame["many"].to_numpy()[of]]

        for batch in batches:
            held.append(batch)
            size += int(batch["region"].str.len().sum())
            if size < BUCKET_BYTES:
                continue
            whole = pd.concat(held, ignore_index=True)
            open_ = whole["bucket"] == whole["bucket"].iloc[-1]
            held = [whole[open_]]
            size = int(held[0]["region"].str.len().sum())
            if not open_.all():
                yield done(whole[~open_].reset_index(drop=True))
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return sort


def _counted(regions: DataFrame, length: int) -> DataFrame:
    """(digest, a, b) as ``_sorted_buckets`` gives them, by counting the suffixes of all ``regions``, which differ from each other."""
    @F.pandas_udf("array<binary>")
    def digests(batch: pd.Series) -> pd.Series:
        return pd.Series([[hashlib.md5(r[p:p + length]).digest() for p in range(len(r) - length + 1)] for r in batch], dtype=object)

    suffixes = cut(regions.select("digest", "many", digests("region").alias("suffixes")).select(
        "digest", "many", F.posexplode("suffixes").alias("first", "suffix")))
    shared = suffixes.groupBy("suffix").count().filter("count > 1").select("suffix")
    hits = suffixes.filter("not many").join(shared, "suffix", "left_semi")
    # the starts of a region are fewer than ``length``; those that follow each other make a run
    run = F.col("first") - F.row_number().over(Window.partitionBy("digest").orderBy("first"))
    return hits.select("digest", "first", run.alias("run")).groupBy("digest", "run").agg(
        F.min("first").cast("bigint").alias("a"), F.max("first").cast("bigint").alias("b")).drop("run")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumn("__data", data).withColumn("__key", F.unhex(F.md5("__data")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
            hot_runs: int = HOT_RUNS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``key`` (MD5 of the text's bytes), ``starts`` and ``stops`` of repeated stretches, which may overlap.

    Texts without repeats have no row.
    """
    spark = docs.sparkSession
    # sorting takes about 60 times the bytes of a batch
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BUCKET_BYTES))
    base = _keyed(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")), "text")
    drawn = cut(base.select("id", F.col("__key").alias("key"), F.col("__data").alias("data")).mapInArrow(
        tidy(_sketch(length, gram)), "id string, key binary, n_bytes bigint, buckets array<bigint>, firsts array<bigint>, lasts array<bigint>"))
    texts = cut(drawn.filter(F.col("n_bytes") >= length).groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("id"), F.first("n_bytes").alias("n_bytes"),
        *[F.first(c).alias(c) for c in ("buckets", "firsts", "lasts")]))
    runs = texts.select("key", "id", F.explode(F.arrays_zip("buckets", "firsts", "lasts")).alias("run")).select(
        "key", "id", F.col("run.buckets").alias("bucket"), F.col("run.firsts").alias("first"), F.col("run.lasts").alias("last"))
    shared = cut(runs.groupBy("bucket").count().filter("count > 1").select("bucket", (F.col("count") > hot_runs).alias("hot")))
    wanted = cut(runs.join(shared, "bucket").groupBy("key", "id").agg(F.collect_list(F.struct("bucket", "first", "last", "hot")).alias("runs")))
    # one document of each text; without ids any row does, and rows that repeat are copies anyway
    own = base.select("id", F.col("__key").alias("key"), F.col("__data").alias("data"))
    one = own.join(wanted.withColumnRenamed("id", "__id").withColumnRenamed("key", "__k"),
                   (F.col("key") == F.col("__k")) & F.col("id").eqNullSafe(F.col("__id")))
    regions = cut(one.select("key", "data", "runs").mapInPandas(
        tidy(_regions(length)), "bucket bigint, region binary, digest binary, key binary, firsts array<bigint>"))
    distinct = cut(regions.groupBy("digest").agg(
        F.first("bucket").alias("bucket"), F.first("region").alias("region"), (F.sum(F.size("firsts")) > 1).alias("many")))
    whole_regions = distinct.filter("region is not null")
    large = cut(whole_regions.groupBy("bucket").agg(F.sum(F.length("region")).alias("bytes")).filter(F.col("bytes") > hot_bytes)
                .select("bucket").repartition(1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = whole_regions.join(large, "bucket", "left_anti").repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(
        tidy(_sorted_buckets(length)), "digest binary, a bigint, b bigint")
    if not large.isEmpty():
        sorted_ = sorted_.union(_counted(whole_regions.join(large, "bucket", "left_semi"), length))
    every = distinct.filter("many").select("digest", F.lit(0).cast("bigint").alias("a"),
                                           F.coalesce(F.length("region") - length, F.lit(0)).cast("bigint").alias("b"))
    ranges = cut(sorted_.union(every).withColumnRenamed("digest", "__digest"))
    found = regions.select("key", "digest", "firsts").join(ranges, F.col("digest") == F.col("__digest"))
    # a region that a text holds many times stays one row; its places are bounded by the text
    spans = found.groupBy("key").agg(F.flatten(F.collect_list(F.transform("firsts", lambda p: F.struct(
        (p + F.col("a")).alias("start"), (p + F.col("b") + length).alias("stop"))))).alias("spans"))
    whole = texts.filter("copies > 1").select("key", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    single = texts.filter("copies = 1").select(F.col("key").alias("__key"))
    spans = spans.join(single, F.col("key") == F.col("__key"), "left_semi")
    return spans.union(whole).select("key", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))


def merged(starts, stops) -> list[tuple[int, int]]:
    """Maximal stretches of overlapping or touching ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut_out(data: Column, starts: Column, stops: Column, characters: bool) -> Column:
    kind = "string" if characters else "binary"

    @F.pandas_udf(f"kept {kind}, firsts array<bigint>, ends array<bigint>")
    def cut_out(data: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        rows = []
        for d, a, b in zip(data, starts, stops):
            if a is None:
                rows.append((None, [], []))
                continue
            spans = merged(a, b)
            at, parts = 0, []
            for x, y in spans:
                parts.append(d[at:x])
                at = y
            kept = b"".join(parts) + d[at:]
            rows.append((kept.decode("utf-8", "ignore") if characters else kept, [x for x, _ in spans], [y for _, y in spans]))
        return pd.DataFrame(rows, columns=["kept", "firsts", "ends"])

    # a text without repeats need not go to Python
    return cut_out(F.when(starts.isNotNull(), data), starts, stops)


def strip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", into: str = "deduplicated", characters: bool = False,
          **options) -> DataFrame:
    """``docs`` with a struct ``into``: n_bytes, kept (the bytes that stay), spans (removed, as start and stop).

    With ``characters``, kept is a string without the characters of which only some bytes stay.
    """
    spans = cut(repeats(docs, id_col, text, **options).withColumnRenamed("key", "__span_key"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = _keyed(docs.select(F.col(text).alias("__text"), row.alias("__row")), "__text").drop("__text")
    joined = keyed.join(spans, F.col("__key") == F.col("__span_key"), "left").withColumn(
        "__cut", _cut_out(F.col("__data"), F.col("starts"), F.col("stops"), characters))
    whole = F.coalesce(F.col("__row").getField(text), F.lit("")) if characters else F.col("__data")
    found = F.struct(F.length("__data").cast("bigint").alias("n_bytes"), F.coalesce("__cut.kept", whole).alias("kept"),
                     F.arrays_zip(F.col("__cut.firsts").alias("start"), F.col("__cut.ends").alias("stop")).alias("spans"))
    return joined.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != into], found.alias(into))


def n_removed(into: str = "deduplicated") -> Column:
    return F.aggregate(f"{into}.spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])


def strip_text(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated stretches taken out of ``text``, and every other column as it is.

    A character of which only some bytes are repeated goes as a whole. Null stays null.
    """
    found = strip(docs, id_col, text, into="__deduplicated", characters=True, **options)
    new = F.when(F.col(f"`{text}`").isNotNull(), F.col("__deduplicated.kept"))
    return found.select(*[(new if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
