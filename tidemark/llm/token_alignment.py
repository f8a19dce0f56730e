"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked id pairs.

Tokenizer A (byte-level BPE) encodes space + text, tokenizer B (pieces with byte
fallback) the text, to which it adds that space itself. Both are then sequences of byte
ranges over the same bytes: the places where both end cut them into groups, and two
tokens are linked where their ranges overlap.

How often an id pair is linked in the whole corpus is counted without a shuffle of
links. The *distinct* pairs, whose number is bounded by the vocabularies and not by the
corpus, get a minimal perfect hash: shards of ``SHARD_PAIRS`` keys, each with a cascade of
bit arrays (a key's slot is the rank of the first level's bit that it has alone), and
the keys in slot order, so that a foreign key is told from a known one. A task counts
into dense vectors indexed by hash, one per shard, and the vectors are summed in a
tree. A second pass aligns the documents again from their stored ids and looks the
counts up. Both passes go by blocks of shards of at most ``BLOCK_PAIRS`` pairs, which
is what a task holds and what is broadcast; usually one block has them all.

Texts that are null, empty, or whose tokens do not spell space + text have no tokens.
Copies count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import give_back, tidy
from tidemark.session import cut

SHARD_PAIRS = 200_000
BLOCK_PAIRS = 4_000_000
# A task hands on its distinct pairs whenever it holds so many.
FLUSH_PAIRS = 1_000_000
# Vectors of a shard that one task adds up.
FAN = 32
BATCH_BYTES = 2 << 20
# Longer texts go to tokenizer B in parts, cut where no piece can reach across.
PART = 1 << 20
# One space between two visible ASCII characters.
BORDER = re.compile(r"[!-~] (?=[!-~])")


# ---------------------------------------------------------------- tokenizers


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters are themselves, the rest follow from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {**{chr(b): b for b in seen}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteLevel:
    """Tokenizer A, from its JSON file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_alphabet()
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items()}
        made = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in made]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            raise ValueError(f"{path}: merges are not in the order of ids")
        self.encoding = tiktoken.Encoding("A", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class Pieces:
    """Tokenizer B, from its model file."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece goes on after a blank that follows something else
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, text: str) -> list[int]:
        if not self.parts or len(text) <= PART:
            return self.model.encode(text, num_threads=1)
        ids, start = [], 0
        while border := BORDER.search(text, start + PART):
            ids += self.model.encode(text[start:border.start() + 1], num_threads=1)
            start = border.start() + 2  # the space that is added to the next part stands for this one
        return ids + self.model.encode(text[start:], num_threads=1)


@lru_cache(maxsize=1)
def _tokenizers(a_path: str, b_path: str, pattern: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path, pattern), Pieces(b_path)


def encode(text: Column, a_path: str, b_path: str, pattern: str) -> Column:
    """Packed ids of both tokenizers (little-endian unsigned 32-bit integers), empty where they do not spell the text."""
    @F.pandas_udf("struct<a: binary, b: binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a, b = _tokenizers(a_path, b_path, pattern)
        a_bytes, b_bytes = a.bytes.__getitem__, b.bytes.__getitem__
        try:
            for batch in batches:
                out: list[tuple[bytes, bytes]] = []
                for text in batch:
                    if text:
                        left, right, data = a.encode(text), b.encode(text), (" " + text).encode()
                        if b"".join(map(a_bytes, left)) == data and b"".join(map(b_bytes, right)) == data:
                            out.append((np.array(left, "<u4").tobytes(), np.array(right, "<u4").tobytes()))
                            continue
                    out.append((b"", b""))
                yield pd.DataFrame(out, columns=["a", "b"])
        finally:
            # workers live on; the passes that follow need no tokenizers
            del a, b, a_bytes, b_bytes
            _tokenizers.cache_clear()
            give_back()

    return both(text)


# ----------------------------------------------------------------- alignment


class Aligned:
    """Links and groups of a batch of documents, by numpy over all their tokens at once."""

    def __init__(self, a: list[bytes], b: list[bytes], a_len: np.ndarray, b_len: np.ndarray):
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in (a, b))
        a_end, b_end = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        total = int(a_end[-1]) if len(a_end) else 0
        ends = np.zeros(total + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] += 2
        at = np.flatnonzero(ends)
        kind = ends[at]
        self.a_ends, self.b_ends = (kind & 1) != 0, kind >= 2
        self.common = kind == 3
        # a link for each stretch between neighbouring ends
        self.link_a, self.link_b = np.cumsum(self.a_ends) - self.a_ends, np.cumsum(self.b_ends) - self.b_ends
        self.group = np.cumsum(self.common) - self.common
        last = np.concatenate([[0], a_end])[np.cumsum(self.n_a)]
        self.borders = np.concatenate([[0], np.searchsorted(at, last, "right")])

    def pairs(self) -> np.ndarray:
        return (self.a[self.link_a] << 32) | self.b[self.link_b]

    def per_document(self, of_links: np.ndarray) -> np.ndarray:
        """Sums over the links of each document."""
        return np.diff(np.concatenate([[0], np.cumsum(of_links, dtype=np.int64)])[self.borders])

    def groups(self, names: list[str], b_from: int) -> list[str]:
        """``a1,a2|b1;a3|b2``: the ids of each group. ``names`` holds each id before "," and before the mark after a last one."""
        a_group, b_group = self.group[self.a_ends], self.group[self.b_ends]
        n = len(a_group) and int(self.group[-1]) + 1
        in_a, in_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        a_place = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[a_group]
        b_place = np.arange(len(self.b)) + np.cumsum(in_a)[b_group]
        merged = np.empty(len(self.a) + len(self.b), np.int64)
        merged[a_place] = 2 * self.a + (np.diff(a_group, append=-1) != 0)
        merged[b_place] = b_from + 2 * self.b + (np.diff(b_group, append=-1) != 0)
        borders, name = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]), names.__getitem__
        return ["".join(map(name, merged[s:e].tolist()))[:-1] for s, e in zip(borders, borders[1:])]


@lru_cache(maxsize=1)
def _names(n_a: int, n_b: int) -> list[str]:
    return [f"{i}{mark}" for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for mark in (",", last)]


# ------------------------------------------------------ minimal perfect hash


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 99) % np.uint64(shards)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n-1 of n distinct keys; other keys have none."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys
        self.sizes = [len(x) for x in levels]
        self.before = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        """Level by level, keys alone in their place stay, the others go on."""
        levels, left = [], keys
        while len(left):
            place = (mixed(left, len(levels)) % np.uint64(2 * len(left))).astype(np.int64)
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[place]]
        hashed = PerfectHash(levels, keys)
        slots, ordered = hashed.slots(keys, verify=False), np.empty_like(keys)
        ordered[slots] = keys
        hashed.keys = ordered
        return hashed

    def slots(self, keys: np.ndarray, verify: bool = True) -> np.ndarray:
        """The slot of each key, -1 of keys that were not among those it was built for."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = (mixed(keys[open_], level) % np.uint64(self.sizes[level])).astype(np.int64)
            here = bits[place] == 1
            out[open_[here]] = self.before[level] + self.ranks[level][place[here]]
            open_ = open_[~here]
        if verify and len(self.keys):
            out[self.keys[out] != keys] = -1
        return out

    def packed(self) -> bytes:
        return b"".join(np.packbits(x.astype(np.uint8)).tobytes() for x in self.levels)

    @staticmethod
    def unpack(sizes: list[int], bits: bytes, keys: bytes) -> "PerfectHash":
        levels, at = [], 0
        for n in sizes:
            width = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, width, at))[:n].astype(np.int64))
            at += width
        return PerfectHash(levels, np.frombuffer(keys, np.int64))


def build_hash(pairs: DataFrame) -> DataFrame:
    """A perfect hash of the distinct ``pair``s, one row a shard: shard, shards, n, sizes, bits, keys."""
    n = pairs.count()
    shards = max(1, -(-n // SHARD_PAIRS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash.build(np.sort(group["pair"].to_numpy(np.int64)))
        return pd.DataFrame([(int(group["shard"].iloc[0]), shards, len(made.keys), made.sizes, made.packed(), made.keys.tobytes())],
                            columns=["shard", "shards", "n", "sizes", "bits", "keys"])

    @F.pandas_udf("long")
    def shard(pair: pd.Series) -> pd.Series:
        return pd.Series(shard_of(pair.to_numpy(np.int64), shards))

    return pairs.select("pair", shard("pair").alias("shard")).groupBy("shard").applyInPandas(
        build, "shard long, shards long, n long, sizes array<long>, bits binary, keys binary")


class Block:
    """The perfect hashes of some shards, and the counts of their keys once these are known."""

    def __init__(self, rows: list, counts: dict[int, bytes] | None = None, best: np.ndarray | None = None):
        self.rows, self.best = [tuple(r) for r in rows], best
        self.counts = {k: np.frombuffer(v, np.int64) for k, v in (counts or {}).items()}
        self._hashes = None

    def __getstate__(self):
        return {**self.__dict__, "_hashes": None}

    @property
    def hashes(self) -> dict[int, PerfectHash]:
        if self._hashes is None:
            self._hashes = {shard: PerfectHash.unpack(list(sizes), bits, keys) for shard, _, _, sizes, bits, keys in self.rows}
        return self._hashes

    def found(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard of this block: places in ``keys`` that belong to it, and their slots."""
        shard = shard_of(keys, self.rows[0][1])
        for k, h in self.hashes.items():
            at = np.flatnonzero(shard == k)
            slots = h.slots(keys[at])
            yield k, at[slots >= 0], slots[slots >= 0]

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for k, at, slots in self.found(keys):
            out[at] = self.counts[k][slots]
        return out


def blocks(hashes: DataFrame) -> list[list[int]]:
    """Shards by blocks of at most ``BLOCK_PAIRS`` pairs; only their sizes come to the driver."""
    out, held = [], BLOCK_PAIRS + 1
    for shard, n in hashes.select("shard", "n").orderBy("shard").collect():
        if held + n > BLOCK_PAIRS:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += n
    return out


# -------------------------------------------------------------------- passes


def _batches(records: Iterator[pa.RecordBatch], a_len: np.ndarray, b_len: np.ndarray) -> Iterator[Aligned]:
    for r in records:
        a, b = (r.column(k).to_pylist() for k in range(2))
        yield Aligned(a, b, a_len, b_len)


def distinct_pairs(ids: DataFrame, a_len: np.ndarray, b_len: np.ndarray) -> DataFrame:
    """``pair`` of all linked id pairs; tasks hand on only what is new to them."""
    def run(records):
        held = np.zeros(0, np.int64)
        for batch in _batches(records, a_len, b_len):
            held = np.union1d(held, pd.unique(batch.pairs()))
            if len(held) > FLUSH_PAIRS:
                yield pa.record_batch([pa.array(held)], ["pair"])
                held = held[:0]
        yield pa.record_batch([pa.array(held)], ["pair"])

    return ids.mapInArrow(tidy(run), "pair long").distinct()


def count_pairs(ids: DataFrame, block, a_len: np.ndarray, b_len: np.ndarray) -> DataFrame:
    """``shard`` and ``counts``, the dense vector of its pairs' links in all documents."""
    def run(records):
        known, sums = block.value, {}
        for batch in _batches(records, a_len, b_len):
            codes, pairs = pd.factorize(batch.pairs())
            n = np.bincount(codes, minlength=len(pairs))
            for k, at, slots in known.found(pairs):
                if len(at):
                    total = sums.setdefault(k, np.zeros(len(known.hashes[k].keys), np.int64))
                    total[slots] += n[at]
        for k, total in sums.items():
            yield pa.record_batch([pa.array([k]), pa.array([total.tobytes()], pa.binary())], ["shard", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["counts"].iloc[0]) // 8, np.int64)
        for vector in group["counts"]:
            total += np.frombuffer(vector, np.int64)
        return pd.DataFrame([(int(group["shard"].iloc[0]), total.tobytes())], columns=["shard", "counts"])

    sums = cut(ids.mapInArrow(tidy(run), "shard long, counts binary"))
    most = sums.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        most = -(-most // FAN)
        # most is rounded up to equal parts: a task adds about FAN vectors of a shard
        dealt = sums.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(most)) if most > 1 else F.lit(0))
        sums = cut(dealt.groupBy("shard", "__part").applyInPandas(add, "shard long, counts binary"))
    return sums


def look_up(a: Column, b: Column, done: Column, block, a_len: np.ndarray, b_len: np.ndarray, last: bool) -> Column:
    """What is returned of each document; ``done`` holds n_best and count_sum of the blocks before."""
    kind = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

    @F.pandas_udf(f"struct<{kind}>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        known, names = block.value, _names(len(a_len), len(b_len)) if last else None
        for left, right, before in parts:
            batch = Aligned(list(left), list(right), a_len, b_len)
            codes, pairs = pd.factorize(batch.pairs())
            counts = known.counts_of(pairs)
            best = (counts > 0) & (counts == known.best[pairs & 0xFFFFFFFF])
            n_links = np.diff(batch.borders)
            yield pd.DataFrame({
                "n_a": batch.n_a, "n_b": batch.n_b, "n_groups": batch.per_document(batch.common), "n_links": n_links,
                "n_best": batch.per_document(best[codes]) + before["n_best"].to_numpy(),
                "count_sum": batch.per_document(counts[codes]) + before["count_sum"].to_numpy(),
                "groups": batch.groups(names, 2 * len(a_len)) if last else ""})

    return run(a, b, done)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``alignment``: n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    n_best counts links whose pair is the most frequent one of its B id; groups writes
    the ids as ``a1,a2|b1;a3|b2``. A column ``alignment`` of ``docs`` is replaced; other
    columns may have any name. The files must be at these places on every machine.
    """
    spark = docs.sparkSession
    # a batch becomes arrays of about 20 times its bytes
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kept = [c for c in docs.columns if c not in (text, "alignment")]
    a_tokens, b_tokens = _tokenizers(a_path, b_path, pattern)
    a_len, b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (a_tokens, b_tokens))
    row = F.struct(*[docs[c] for c in kept]) if kept else F.lit(None).cast("string")
    stored = cut(docs.select(row.alias("row"), encode(docs[text], a_path, b_path, pattern).alias("ids")))
    ids = stored.select("ids.a", "ids.b")
    hashes = cut(build_hash(cut(distinct_pairs(ids, a_len, b_len))))
    held, sc = blocks(hashes), spark.sparkContext

    def block_of(shards: list[int], counts: DataFrame | None = None, best: np.ndarray | None = None):
        rows = hashes.filter(F.col("shard").isin(shards)).collect()
        vectors = {} if counts is None else {r["shard"]: r["counts"] for r in counts.collect()}
        return sc.broadcast(Block(rows, vectors, best))

    # an empty corpus has no pairs and no blocks
    if not held:
        zero = [F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        return stored.select(*[F.col("row")[c].alias(c) for c in kept], F.struct(*zero, F.lit("").alias("groups")).alias("alignment"))
    counted, best = [], np.zeros(len(b_len), np.int64)
    for shards in held:
        sums = count_pairs(ids, block_of(shards), a_len, b_len)
        counted.append(sums)
        for r in _best(hashes.filter(F.col("shard").isin(shards)).join(sums, "shard")).collect():
            best[r["b"]] = max(best[r["b"]], r["most"])
    done = F.struct(F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for k, shards in enumerate(held):
        last = k == len(held) - 1
        found = look_up(F.col("ids.a"), F.col("ids.b"), done, block_of(shards, counted[k], best), a_len, b_len, last)
        stored = stored.select("row", "ids", found.alias("alignment"))
        if not last:
            stored, done = cut(stored), F.struct("alignment.n_best", "alignment.count_sum")
    return stored.select(*[F.col("row")[c].alias(c) for c in kept], "alignment")


def _best(counted: DataFrame) -> DataFrame:
    """``b`` and ``most``: the highest count of each B id; at most one row an id of the vocabulary."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for keys, counts in zip(part["keys"], part["counts"]):
                both = pd.DataFrame({"b": np.frombuffer(keys, np.int64) & 0xFFFFFFFF, "most": np.frombuffer(counts, np.int64)})
                yield both.groupby("b", as_index=False)["most"].max()

    return counted.select("keys", "counts").mapInPandas(run, "b long, most long").groupBy("b").agg(F.max("most").alias("most"))
