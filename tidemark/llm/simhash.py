"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most four. To find links
without comparing all pairs, fingerprints are sent to anchor points:

* 61 bits are cut into six blocks. Six triples of blocks are chosen such that four
  differing bits, wherever they are, leave a triple with at most one of them
  (``TRIPLES``; a test goes through all cases). A triple has at most 31 bits.
* In the 31-bit space of a triple the anchors are the words of the perfect Hamming
  code, whose covering radius is one: every fingerprint has one *home* anchor within
  distance one. Fingerprints that differ in at most one bit there are within the
  radius plus that threshold, two, of each other's homes. So each fingerprint goes
  to all anchors within distance two, sixteen at most, and at every anchor the ones
  at home are compared, on all 64 bits, with everything that came.

Equal fingerprints are first made one, so copies are compared once however many
there are. At an anchor, links are turned into stars (one edge per fingerprint), so
a dense group does not emit its pairs; anchors that are home to more than
``HOT_HOMES`` fingerprints are dealt out to several tasks. The rest is connected
components of the stars.

Null and empty texts and texts without words have fingerprint zero and link like any
other; ids may repeat or be null (a component without any id has a null id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bounded_batches, bytes_of, spaced_words, tidy
from tidemark.llm.components import components, stars
from tidemark.session import cut

SHINGLE = 4
SEED = 42
THRESHOLD = 4
HOT_HOMES = 1024
PAIRS_AT_ONCE = 1 << 20

BLOCKS = (10, 10, 10, 10, 10, 11)
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
# The Hamming code of length 31: bit i of a word adds i + 1 to the syndrome, by exclusive or.
LENGTH = 31
PARITY = [sum(1 << i for i in range(LENGTH) if (i + 1) >> k & 1) for k in range(5)]


def fingerprint_of(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = spaced_words(data)
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        high = min(n, low + (1 << 16))
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[low:high], ends[min(shingle, len(words)) - 1 + low:])),
                        np.uint64, high - low)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str) -> Column:
    @F.pandas_udf("bigint")
    def simhash(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in batch], dtype="int64")

    return simhash(bytes_of(text))


def hex_of(value: Column) -> Column:
    """Sixteen lower-case hex digits of a 64-bit integer."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def projections(fp: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of each triple of blocks, as numbers of at most 31 bits."""
    offset = np.cumsum((0,) + BLOCKS)
    for triple in TRIPLES:
        out, at = np.zeros(len(fp), np.uint64), 0
        for b in triple:
            out |= ((fp >> np.uint64(offset[b])) & np.uint64((1 << BLOCKS[b]) - 1)) << np.uint64(at)
            at += BLOCKS[b]
        yield out


def syndrome(word: np.ndarray) -> np.ndarray:
    out = np.zeros(len(word), np.int64)
    for k, mask in enumerate(PARITY):
        out |= (np.bitwise_count(word & np.uint64(mask)).astype(np.int64) & 1) << k
    return out


def flipped(word: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """``word`` with the bit of syndrome ``place`` flipped; place 0 flips none."""
    return word ^ ((np.uint64(1) << np.asarray(place, np.uint64)) >> np.uint64(1))


def homes_of(fp: np.ndarray) -> Iterator[np.ndarray]:
    """For each triple, the home anchor of each fingerprint."""
    for table, word in enumerate(projections(fp)):
        yield flipped(word, syndrome(word)).astype(np.int64) | (table << LENGTH)


def visits_of(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, anchors) at distance two, for each triple and first flipped bit."""
    for table, word in enumerate(projections(fp)):
        s = syndrome(word)
        for i in range(1, LENGTH + 1):
            rows = np.flatnonzero((i ^ s) > i) if len(s) else np.zeros(0, np.int64)
            rows = rows[s[rows] != 0]
            yield rows, flipped(flipped(word[rows], i), i ^ s[rows]).astype(np.int64) | (table << LENGTH)


def _homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
        for anchor in homes_of(fp):
            yield pd.DataFrame({"anchor": anchor})


def _replicas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per anchor: slot is twice the anchor, plus one where the fingerprint is not at home."""
    for batch in batches:
        signed = batch["fp"].to_numpy(np.int64)
        fp = signed.view(np.uint64)
        for anchor in homes_of(fp):
            yield pd.DataFrame({"slot": anchor << 1, "fp": signed})
        for rows, anchor in visits_of(fp):
            if len(rows):
                yield pd.DataFrame({"slot": (anchor << 1) | 1, "fp": signed[rows]})


def linked(slot: np.ndarray, fp: np.ndarray, seen: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows at home and rows at the same anchor, of rows sorted by slot.

    The first ``seen`` rows were compared with each other before.
    """
    anchor = slot >> 1
    ends = np.searchsorted(anchor, anchor, side="right")
    home = np.flatnonzero((slot & 1) == 0)
    first = np.maximum(home + 1, seen)
    many = np.maximum(ends[home] - first, 0)
    keep = many > 0
    home, first, many = home[keep], first[keep], many[keep]
    upto = np.cumsum(many)
    low = 0
    while low < len(home):
        done = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
        n = many[low:high]
        left = np.repeat(home[low:high], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[low:high], n)
        differ = np.bitwise_count(fp[left] ^ fp[right])
        near = (differ > 0) & (differ <= threshold)
        if near.any():
            yield fp[left[near]].view(np.int64), fp[right[near]].view(np.int64)
        low = high


def _compare(threshold: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            node, root = stars(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
            return pd.DataFrame({"a": node, "b": root})

        for batch in batches:
            seen = len(slot)
            slot = np.concatenate([slot, batch["slot"].to_numpy(np.int64)])
            fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            for a, b in linked(slot, fp, seen, threshold):
                found.append((a, b))
                size += len(a)
                if size > PAIRS_AT_ONCE:
                    node, root = stars(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                    found, size = [(node, root)], len(node)
                    if size > PAIRS_AT_ONCE // 2:
                        yield pd.DataFrame({"a": node, "b": root})
                        found, size = [], 0
            # those at home at the last anchor meet what the next batch brings to it
            if len(slot):
                last = (slot >> 1 == slot[-1] >> 1) & (slot & 1 == 0)
                slot, fp = slot[last], fp[last]
        if found:
            yield flush()

    return compare


def links(fps: DataFrame, threshold: int = THRESHOLD, hot_homes: int = HOT_HOMES) -> DataFrame:
    """Edges ``a``, ``b`` that connect what links of at most ``threshold`` (4 at most) bits connect.

    ``fps`` has distinct fingerprints in the column fp and is read twice.
    """
    if threshold > THRESHOLD:
        raise ValueError("the triples cover up to four differing bits")
    spark = fps.sparkSession
    crowded = cut(fps.mapInPandas(tidy(_homes), "anchor bigint").groupBy("anchor").count().filter(F.col("count") > hot_homes)
                  .select("anchor", F.ceil(F.col("count") / hot_homes).cast("bigint").alias("parts")))
    rows = fps.mapInPandas(tidy(_replicas), "slot bigint, fp bigint")
    if not crowded.isEmpty():
        # a part of those at home meets everything else at the anchor; the part stands above the anchor's bits
        parts = rows.withColumn("anchor", F.shiftright("slot", 1)).join(crowded, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
        spread = parts.select("slot", "fp", own.alias("own"), F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        rows = spread.select(
            ((F.when(F.col("own") == F.col("part"), F.col("slot")).otherwise(F.col("slot").bitwiseOR(F.lit(1))))
             .bitwiseOR(F.shiftleft("part", 36))).alias("slot"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, F.shiftright("slot", 1)).sortWithinPartitions("slot")
    return dealt.mapInPandas(tidy(_compare(threshold)), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col``, text_hash, fingerprint, component_id, root.

    ``component_id`` is the smallest id that links reach, the document's own included, and ``root`` the
    smallest fingerprint; fingerprints are 64-bit integers.
    """
    bounded_batches(docs.sparkSession)
    own = cut(docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), fingerprint(text).alias("fingerprint")))
    fps = cut(own.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("least")))
    roots = components(links(fps.select("fp"), threshold), "a", "b")
    rooted = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(rooted.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id", "root"))
    return own.join(of, "fingerprint").select(id_col, "text_hash", "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each group, with the columns of ``docs``.

    Among equal ids the text decides, and of rows that repeat both one stays. A null id is larger than any other.
    """
    groups = near_groups(docs, id_col, text, threshold)
    rows = groups.groupBy("root", F.col(id_col).alias("__id"), "text_hash").agg(F.count("*").alias("__n"))
    chosen = cut(rows.groupBy("root").agg(F.min(F.struct(
        F.isnull("__id").alias("no"), F.col("__id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("__n").alias("__n")))
        .alias("x")).select("x.__id", "x.__hash", "x.__n"))
    # columns of documents may have any name, so they stay in one
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    kept = hashed.join(chosen, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left_semi")
    if not chosen.filter("__n > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "hash"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
