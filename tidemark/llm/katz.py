"""A Katz backoff language model of words, and the log probability of whole texts under it.

Tokens of a text are its words (A-Z lower-cased) and one end. A token's probability after
the token before it (or the start) is its Good-Turing discounted bigram count over the count
of that history; a token not seen there backs off to its discounted unigram probability times
the history's weight, and an unseen word to the mass that Good-Turing leaves for all unseen
words together. The weights are normalised exactly: what discounting left of a history, over
what its followers do not take of the unigrams. A history that discounting leaves nothing
divides by one count more instead, which then is its mass for unseen tokens; likewise the unigrams.

Counts grow with the corpus, so nothing is broadcast but what is bounded: the discounts and
the few *hot* words and pairs. Tables are partitioned into buckets by the history's hash, so
many that a bucket covers about ``BUCKET_BYTES`` of text, and a bucket's counts travel packed:

* ``count``: tasks count the pairs of each batch and send them by bucket, where they are added up.
* ``weigh``: buckets ask each other for the unigram counts of their followers, each word once.
* ``score``: in ``ROUNDS`` parts of the documents, the batches' pairs go to the buckets, with the documents that hold them; what is
  seen there is scored, what is not goes on to the bucket of the word. Sums come back by batch.

A word (or pair) with over a ``HOT``-th of a sample's tokens is hot. A hot history's pairs are
dealt out by both words; counts of hot words and pairs are known to all tasks. Which are hot
only decides where rows go, never a result.

Words are told apart by 64 bits of XXH3: among 100 million different words two share them
with a chance of 0.0003. Null and empty texts are just the end. Nothing to learn from leaves
a model that gives every token probability 1. Equal rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import ASCII_LOWER, let_go, tidy
from tidemark.session import cut

BUCKET_BYTES = 16 << 20
# A bucket's counts are rows of at most so many pairs.
CHUNK = 1 << 16
# Counts up to this are discounted.
K = 5
HOT = 500
SAMPLE_BYTES = 16 << 20
# Tokens whose pairs a task makes distinct at once.
WINDOW = 1 << 19
# Documents are scored in so many rounds, which bounds the pairs that are under way at once.
ROUNDS = 3
# Words whose hash a task remembers, bytes of text split at once, unseen tokens sent on at once.
MEMORY = 150_000
PART = 2 << 20
AT_ONCE = 1 << 19
BLANK = re.compile(rb"[\x20\x09-\x0D]")
# Not words: they hold a space.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))


def _small_batches(spark: SparkSession) -> None:
    """A batch becomes arrays of about 30 times its bytes, so it is bounded below the other operators'."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(3 << 20))


# -------------------------------------------------------------------- texts


class Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        known = self[word] = xxhash.xxh3_64_intdigest(word)
        return known


def word_ids(text: str | None, hashes: Hashes) -> np.ndarray:
    data, out, start = (text or "").encode().translate(ASCII_LOWER), [], 0
    while True:
        border = BLANK.search(data, start + PART) if len(data) - start > PART else None
        words = (data[start:border.start()] if border else data[start:]).split()
        out.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        if border is None:
            return np.concatenate(out)
        start = border.end()


def pairs_of(texts: list[str | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History and token of every token of the texts, and the number of tokens of each text."""
    ids = [word_ids(t, hashes) for t in texts]
    n = np.array([len(x) + 1 for x in ids], np.int64)
    words = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    place = np.arange(len(words)) + np.repeat(np.arange(len(ids)), n - 1)
    ends = np.cumsum(n)
    h, w = np.empty(len(words) + len(ids), np.uint64), np.empty(len(words) + len(ids), np.uint64)
    w[place], w[ends - 1] = words, END
    h[place + 1], h[ends - n] = words, START
    return h, w, n


def fused(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a pair; equal ones are compared in full afterwards."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def place_in(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of ``asked`` in the sorted ``known``, -1 where they are not."""
    if not len(known):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


@dataclass
class Routes:
    """Where pairs and words live; the same for all tasks."""

    buckets: int
    hot: np.ndarray = field(default_factory=lambda: np.sort(np.array([START, END])))
    hot_pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.uint64))

    def of_words(self, w: np.ndarray) -> np.ndarray:
        """Buckets by ranges of the hash, so that sorted words have sorted buckets."""
        return ((w >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def of_pairs(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        hot = place_in(self.hot, h) >= 0
        return self.of_words(np.where(hot, fused(h, w), h))


def _slices(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(np.diff(sorted_buckets)) + 1
    for s, e in zip([0, *at], [*at, len(sorted_buckets)]):
        if e > s:
            yield int(sorted_buckets[s]), int(s), int(e)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal numbers."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(h)))


def _pack(*arrays: tuple[np.ndarray, str]) -> list[bytes]:
    return [a.astype(kind).tobytes() for a, kind in arrays]


def _distinct(h: np.ndarray, w: np.ndarray, routes: Routes, doc: np.ndarray | None = None) -> tuple:
    """The distinct pairs by bucket and history: bucket, h, w, their numbers, and the documents of their occurrences in that order."""
    codes, _ = pd.factorize(fused(h, w))
    first = np.empty(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if not (np.array_equal(h[first][codes], h) and np.array_equal(w[first][codes], w)):  # two pairs with one number
        codes = np.unique(np.stack([h, w]), axis=1, return_inverse=True)[1].ravel()
        first = np.empty(codes.max() + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
    h1, w1 = h[first], w[first]
    bucket, order = routes.of_pairs(h1, w1), np.argsort(h1)
    order = order[np.argsort(bucket[order], kind="stable")]
    docs = None
    if doc is not None:
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        docs = np.sort(rank[codes] << 32 | doc) & 0xFFFFFFFF
    return bucket[order], h1[order], w1[order], np.bincount(codes, minlength=len(order))[order], docs


# ------------------------------------------------------------------- counts

COUNTS = "bucket long, h binary, k binary, w binary, c binary"
SEQ_BITS = 20


def _windows(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Arrays of batches joined to about ``WINDOW`` numbers."""
    held, size = [], 0
    for arrays in batches:
        held.append(arrays)
        size += len(arrays[0])
        if size >= WINDOW:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _by_bucket(rows: DataFrame, key: str = "bucket", *then: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *then)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    return groupby(rows, key=lambda r: r[0])


def _records(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about a megabyte."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > 1 << 20 or len(held) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)


def routes_of(texts: DataFrame, n_bytes: int) -> Routes:
    """Number of buckets, and the hot words and pairs of a sample."""
    routes = Routes(max(1, -(-n_bytes // BUCKET_BYTES)))
    if n_bytes < SAMPLE_BYTES // 8:  # too little for a skew to matter
        return routes

    def run(batches):
        hashes = Hashes()
        for b in batches:
            h, w, _ = pairs_of(b.column(0).to_pylist(), hashes)
            least, out = len(h) / (2 * HOT), [(-1, 0, 0, len(h))]
            ids, n = np.unique(h, return_counts=True)
            out += [(0, i, 0, k) for i, k in zip(ids[n > least].view(np.int64).tolist(), n[n > least].tolist())]
            _, ph, pw, pn, _ = _distinct(h, w, routes)
            out += [(1, i, j, k) for i, j, k in zip(ph[pn > least].view(np.int64).tolist(), pw[pn > least].view(np.int64).tolist(), pn[pn > least].tolist())]
            yield from _records(iter(out), "kind long, h long, w long, n long")

    share = min(1.0, SAMPLE_BYTES / n_bytes)
    seen = (texts if share == 1 else texts.sample(share, 7)).mapInArrow(tidy(run), "kind long, h long, w long, n long")
    sums = cut(seen.groupBy("kind", "h", "w").agg(F.sum("n").alias("n")))
    total = sums.filter("kind = -1").agg(F.sum("n")).first()[0] or 0
    # each has more than a HOT-th of the sample: at most HOT words and HOT pairs
    rows = sums.filter((F.col("kind") >= 0) & (F.col("n") > total / HOT)).collect()
    routes.hot = np.unique(np.array([START, END, *[np.int64(r["h"]).astype(np.uint64) for r in rows if r["kind"] == 0]], np.uint64))
    routes.hot_pairs = np.array([(np.int64(r["h"]).astype(np.uint64), np.int64(r["w"]).astype(np.uint64)) for r in rows if r["kind"] == 1],
                                np.uint64).reshape(-1, 2)
    return routes


def count(texts: DataFrame, routes: Routes) -> DataFrame:
    """The bigram counts of a column of texts, packed, with counts of counts and what is known of hot ones; a row a ``chunk`` of a bucket.

    h holds the histories in order, k how many tokens follow each, w these tokens, c the
    counts of the pairs, total those of the histories (without hot ones in ``word``, ``word_n``).
    """
    hot, hot_pairs = routes.hot, fused(routes.hot_pairs[:, 0], routes.hot_pairs[:, 1])

    def tell(batches):
        hashes = Hashes()
        for parts in _windows((pairs_of(b.column(0).to_pylist(), hashes)[:2] for b in batches)):
            bucket, h, w, n, _ = _distinct(*parts, routes)
            yield from _records(((k, *_packed(h[s:e], w[s:e], n[s:e])) for k, s, e in _slices(bucket)), COUNTS)

    def add(batches):
        def out():
            for bucket, rows in _groups(batches):
                h, w, c = (np.concatenate(x) for x in zip(*[_unpacked(*r[1:]) for r in rows]))
                order = np.lexsort((w, h))
                h, w, c = h[order], w[order], c[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
                h, w, c = h[new], w[new], np.add.reduceat(c, new)
                starts, _ = _runs(h)
                words, total = h[starts], np.add.reduceat(c, starts)
                here = place_in(hot, words) >= 0
                words, total, hot_h, hot_n = words[~here], total[~here], words[here], total[here]
                of_pairs = np.flatnonzero(np.isin(fused(h, w), hot_pairs))
                pairs = h[of_pairs].view(np.int64).tolist(), w[of_pairs].view(np.int64).tolist(), c[of_pairs].tolist()
                for seq in range(parts := -(-len(c) // CHUNK)):
                    h1, w1, c1, words1, total1 = (np.array_split(x, parts)[seq] for x in (h, w, c, words, total))
                    more = [hot_h.view(np.int64).tolist(), hot_n.tolist(), *pairs] if seq == 0 else [[]] * 5
                    yield (bucket, *_packed(h1, w1, c1), bucket << SEQ_BITS | seq, *_pack((words1, "<u8"), (total1, "<u8")),
                           np.bincount(np.minimum(c1, K + 2), minlength=K + 3).tolist(),
                           np.bincount(np.minimum(total1, K + 2), minlength=K + 3).tolist(), int(total1.sum()), *more)

        yield from _records(out(), full)

    full = COUNTS + ", chunk long, word binary, word_n binary" + "".join(f", {c} array<long>" for c in ("of_pairs", "of_words")) + ", tokens long" + "".join(
        f", {c} array<long>" for c in ("hot_h", "hot_n", "pair_h", "pair_w", "pair_n"))
    return _by_bucket(texts.mapInArrow(tidy(tell), COUNTS)).mapInArrow(tidy(add), full)


def _packed(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[bytes]:
    starts, k = _runs(h)
    return [*_pack((h[starts], "<u8"), (k, "<u4")), _pack_words(w), n.astype("<u8").tobytes()]


def _pack_words(w: np.ndarray) -> bytes:
    """Words as their number, the distinct ones and places among these."""
    words, places = np.unique(w, return_inverse=True)
    return b"".join(_pack((np.array([len(words)]), "<u8"), (words, "<u8"), (places, "<u2" if len(words) <= 1 << 16 else "<u4")))


def _distinct_words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8", int(np.frombuffer(data, "<u8", 1)[0]), 8)


def _words_of(data: bytes) -> np.ndarray:
    words = _distinct_words(data)
    return words[np.frombuffer(data, "<u2" if len(words) <= 1 << 16 else "<u4", offset=8 + 8 * len(words))]


def _unpacked(h: bytes, k: bytes, w: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(h, "<u8"), np.frombuffer(k, "<u4")), _words_of(w), np.frombuffer(n, "<u8").astype(np.int64)


# -------------------------------------------------------------------- model


def discounts(n: list[int]) -> np.ndarray:
    """The factor of each count (1 from the first that is not discounted on), by Good-Turing from numbers of counts ``n[r]``.

    Katz's factors for the largest limit up to ``K`` whose numbers are all there and whose factors lie in (0, 1].
    """
    for k in range(K, 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            over = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) if over < 1 else 0 for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                return np.array([1.0, *d, *[1.0] * (K + 2 - k)])
    return np.ones(K + 3)


@dataclass
class Known:
    """What every task knows: discounts, totals and hot words and pairs; its size does not grow with the corpus."""

    routes: Routes
    pair_d: np.ndarray
    word_d: np.ndarray
    tokens: int
    vocabulary: int
    ends: int
    over: int  # one more count, where discounting leaves unseen words nothing
    unseen: float
    hot_n: np.ndarray
    pair_n: np.ndarray
    hot_left: np.ndarray = None
    hot_lower: np.ndarray = None

    def word_p(self, n: np.ndarray) -> np.ndarray:
        """Unigram probabilities of words by their counts; 0 counts are the unseen."""
        n = n.astype(np.int64)
        p = self.word_d[np.minimum(n, K + 2)] * n / max(self.tokens + self.over, 1)
        return np.where(n > 0, p, self.unseen)

    def left(self, c: np.ndarray) -> np.ndarray:
        """What discounting takes from each pair's count."""
        return (1 - self.pair_d[np.minimum(c, K + 2)]) * c

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))

    def over_and_weight(self, total: np.ndarray, left: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a history's counts are divided by, and log10 of its backoff weight."""
        none = left <= 1e-9 * np.maximum(total, 1)
        over = total + none
        mass = np.where(none, 1.0, left) / np.maximum(over, 1)
        weight = np.log10(mass) - np.log10(np.maximum(1 - lower, self.unseen))
        return over, np.where(total > 0, weight, 0.0)


@dataclass
class Model:
    """``counts`` and ``weights`` are tables by bucket; ``known`` goes to every task."""

    counts: DataFrame
    weights: DataFrame
    known: Known


def _known(counts: DataFrame, routes: Routes) -> Known:
    each = [F.sum(F.get(c, F.lit(r))).alias(f"{c}{r}") for c in ("of_pairs", "of_words") for r in range(K + 3)]
    sums = counts.agg(F.sum("tokens").alias("tokens"), *each).first().asDict()
    at = lambda c: [int(sums[f"{c}{r}"] or 0) for r in range(K + 3)]
    add = lambda cols: counts.select(F.explode(F.arrays_zip(*cols)).alias("x")).select("x.*").groupBy(*cols[:-1]).agg(F.sum(cols[-1]).alias("n")).collect()
    hot = {np.int64(h).astype(np.uint64): n for h, n in add(["hot_h", "hot_n"])}
    pairs = {(np.int64(h).astype(np.uint64), np.int64(w).astype(np.uint64)): n for h, w, n in add(["pair_h", "pair_w", "pair_n"])}
    # every text has one start and one end
    ends = hot.get(START, 0)
    hot_n = np.array([ends if w == END else hot.get(w, 0) for w in routes.hot], np.int64)
    words = at("of_words")
    for w, n in zip(routes.hot, hot_n):
        if w != START and n:
            words[min(n, K + 2)] += 1
    tokens = int(sums["tokens"] or 0) + int(hot_n[routes.hot != START].sum())
    d = discounts(words)
    left = sum((1 - d[r]) * r * words[r] for r in range(1, K + 1))
    over = int(tokens > 0 and left <= 0)
    return Known(routes, discounts(at("of_pairs")), d, tokens, sum(words[1:]), ends, over, (left or 1) / (tokens + over) if tokens else 1.0,
                 hot_n, np.array([pairs.get((h, w), 0) for h, w in routes.hot_pairs], np.int64))


def _ask(counts: DataFrame, known: Known) -> DataFrame:
    """Each chunk's followers, once each, to the buckets that count them."""
    routes = known.routes

    def run(batches):
        def out():
            for b in batches:
                for chunk, w in zip(*[c.to_pylist() for c in b.columns]):
                    asked = _asked(w, routes)
                    yield from ((k, 1, chunk, asked[s:e].tobytes(), None) for k, s, e in _slices(routes.of_words(asked)))

        yield from _records(out(), "to long, turn long, chunk long, w binary, n binary")

    return counts.select("chunk", "w").mapInArrow(tidy(run), "to long, turn long, chunk long, w binary, n binary")


def _asked(w: bytes, routes: Routes) -> np.ndarray:
    w = _distinct_words(w)
    return w[place_in(routes.hot, w) < 0]


def _words(counts: DataFrame, more: str) -> DataFrame:
    """The word counts of each bucket, before what is asked there."""
    return counts.select(F.col("bucket").alias("to"), F.lit(0).cast("long").alias("turn"), F.lit(None).cast("long").alias(more),
                         F.col("word").alias("w"), F.col("word_n").alias("n"))


def _looked_up(rows: Iterator[tuple], answer: Callable) -> Iterator[tuple]:
    """Of one bucket's rows: the word counts come first, then what is asked."""
    words, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, turn, more, w, x in rows:
        if turn == 0:
            words.append(np.frombuffer(w, "<u8"))
            n.append(np.frombuffer(x, "<u8").astype(np.int64))
            continue
        if len(words) > 1:
            words, n = [np.concatenate(words)], [np.concatenate(n)]
            order = np.argsort(words[0])
            words, n = [words[0][order]], [n[0][order]]
        at = place_in(words[0], np.frombuffer(w, "<u8"))
        yield from answer(more, x, np.where(at >= 0, n[0][at], 0) if len(n[0]) else np.zeros(len(at), np.int64))


WEIGHTS = "bucket long, h binary, total binary, left binary, lower binary, hot_h array<long>, hot_left array<double>, hot_lower array<double>"


def weigh(counts: DataFrame, known: Known) -> DataFrame:
    """Of each chunk's histories: count, what discounting leaves, and the unigram mass of their followers; in parts where chunks part them."""
    routes = known.routes
    two = "chunk long, turn long, to long, bucket long, h binary, k binary, w binary, c binary"

    def tell(batches):
        def out():
            for to, rows in _groups(batches):
                yield from _looked_up(rows, lambda chunk, _, n: [(chunk, 1, to, None, None, None, None, n.astype("<u8").tobytes())])

        yield from _records(out(), two)

    def run(batches):
        def out():
            for _, rows in _groups(batches):
                _, _, _, bucket, h, k, w, c = next(rows)
                asked, answers = _asked(w, routes), [np.frombuffer(r[7], "<u8") for r in rows]
                h, k, w, c = np.frombuffer(h, "<u8"), np.frombuffer(k, "<u4").astype(np.int64), _words_of(w), np.frombuffer(c, "<u8").astype(np.int64)
                p = known.word_p(np.concatenate(answers)) if answers else np.zeros(0)
                at, hot = place_in(asked, w), place_in(routes.hot, w)
                p = np.where(at >= 0, p[at] if len(p) else 0.0, known.word_p(known.hot_n)[hot])
                starts = np.cumsum(k) - k
                total, left, lower = (np.add.reduceat(x, starts) for x in (c, known.left(c), p))
                here = place_in(routes.hot, h) >= 0
                yield (bucket, *_pack((h, "<u8"), (total, "<u8"), (left, "<f8"), (lower, "<f8")), h[here].view(np.int64).tolist(),
                       left[here].tolist(), lower[here].tolist())

        yield from _records(out(), WEIGHTS)

    asked = _words(counts, "chunk").unionByName(_ask(counts, known))
    told = _by_bucket(asked, "to", "turn").mapInArrow(tidy(tell), two)
    own = counts.select("chunk", F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("to"), "bucket", "h", "k", "w", "c")
    return _by_bucket(own.unionByName(told), "chunk", "turn", "to").mapInArrow(tidy(run), WEIGHTS)


def fit(texts: DataFrame, text: str = "text", n_bytes: int | None = None) -> Model:
    """The model of a table's texts; ``n_bytes``, if given, is the size that buckets are made for."""
    _small_batches(texts.sparkSession)
    texts = texts.select(F.col(text).alias("text"))
    size = n_bytes if n_bytes is not None else texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = routes_of(texts, size)
    counts = cut(count(texts, routes))
    known = _known(counts, routes)
    let_go(texts.sparkSession)
    weights = cut(weigh(counts, known))
    known.hot_left, known.hot_lower = np.zeros(len(routes.hot)), np.zeros(len(routes.hot))
    hot = weights.select(F.explode(F.arrays_zip("hot_h", "hot_left", "hot_lower")).alias("x")).select("x.*")
    for h, left, lower in hot.groupBy("hot_h").agg(F.sum("hot_left"), F.sum("hot_lower")).collect():  # at most as many as hot words
        at = place_in(routes.hot, np.array([h]).view(np.uint64))
        known.hot_left[at], known.hot_lower[at] = left, lower
    return Model(counts, weights, known)


# -------------------------------------------------------------------- scores

# Turn 0 and 1 are a bucket's counts and weights, 2 the pairs of a batch.
ASK = "bucket long, turn long, batch long, h binary, k binary, w binary, m binary, d binary, total binary, left binary, lower binary"
# ``part`` is the partition of documents, ``start`` and ``ids`` are places in it; the rest is for tokens that go on.
TOLD = "part long, turn long, start long, ids binary, known binary, base binary, score binary, to long, w binary, uid binary"
ROW_BITS = 33


class Table:
    """One bucket of the model."""

    def __init__(self, known: Known, counts: list[tuple] = (), weights: list[tuple] = ()):
        self.known, hot = known, known.routes.hot
        joined = lambda rows, i, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[i], kind) for r in rows]])
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        of, w, c = (np.concatenate(x) for x in zip(none, *[_unpacked(*r[3:7]) for r in counts]))
        keys = fused(of, w)
        order = np.argsort(keys)
        self.keys, self.h, self.w, self.c = keys[order], of[order], w[order], c[order]
        h, numbers = joined(weights, 3, "<u8"), [joined(weights, i, kind) for i, kind in ((8, "<u8"), (9, "<f8"), (10, "<f8"))]
        own = place_in(hot, h) < 0
        # hot histories are the same in all buckets
        every = np.concatenate([h[own], hot])
        self.histories, codes = np.unique(every, return_inverse=True)
        total, left, lower = (np.bincount(codes, np.concatenate([x[own].astype(float), y]), len(self.histories))
                              for x, y in zip(numbers, (known.hot_n, known.hot_left, known.hot_lower)))
        self.total = total.astype(np.int64)
        self.over, self.weight = known.over_and_weight(self.total, left, lower)

    def look_up(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs: their histories' counts, log10 of seen ones' probabilities or of the weight, and which are seen."""
        at = place_in(self.keys, fused(h, w))
        # another pair may have the same fused number
        for i in np.flatnonzero((at >= 0) & ((self.h[at] != h) | (self.w[at] != w))) if len(self.keys) else ():
            s, key, at[i] = at[i], self.keys[at[i]], -1
            while s < len(self.keys) and self.keys[s] == key:
                if self.h[s] == h[i] and self.w[s] == w[i]:
                    at[i] = s
                s += 1
        of = place_in(self.histories, h)
        total, seen = np.where(of >= 0, self.total[of], 0), at >= 0
        c = np.where(seen, self.c[at] if len(self.c) else 0, 0)
        p = np.where(seen, np.log10(np.maximum(self.known.pair_d[np.minimum(c, K + 2)] * c, 1e-300) / np.maximum(self.over[of], 1)),
                     np.where(of >= 0, self.weight[of], 0.0))
        return total, p, seen


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``katz``: n_tokens, n_known, train_tokens, base_score, score.

    score is the model's log10 probability of the text, base_score that of unigrams with
    half a count added. A column ``katz`` of ``docs`` is replaced. ``docs`` should be read
    from a table: a task that is run again has to see the same rows in the same order.
    """
    _small_batches(docs.sparkSession)
    known, routes = model.known, model.known.routes
    kept = [c for c in docs.columns if c not in (text, "katz")]
    rows = docs.select(F.struct(*[docs[c] for c in kept] or [F.lit(0).alias("_")]).alias("row"), docs[text].alias("text"),
                       F.monotonically_increasing_id().alias("uid"))
    row_type = rows.schema["row"].dataType.simpleString()
    none = lambda c, kind="binary": F.lit(None).cast(kind).alias(c)
    turn = lambda n: F.lit(n).cast("long").alias("turn")
    ends = none("docs", f"array<{row_type}>")
    tables = model.counts.select("bucket", turn(0), none("batch", "long"), "h", "k", "w", F.col("c").alias("m"), none("d"),
                                 none("total"), none("left"), none("lower"), ends).unionByName(
        model.weights.select("bucket", turn(1), none("batch", "long"), "h", none("k"), none("w"), none("m"), none("d"), "total", "left", "lower", ends))
    told = None
    for k in range(ROUNDS):
        asked = rows.filter(F.pmod(F.spark_partition_id(), F.lit(ROUNDS)) == k).mapInArrow(tidy(_requests(known)), f"{ASK}, docs array<{row_type}>")
        answers = _by_bucket(tables.unionByName(asked), "bucket", "turn").mapInArrow(tidy(_answers(known)), f"{TOLD}, docs array<{row_type}>")
        let_go(docs.sparkSession)
        answers = cut(answers)
        told = answers if told is None else told.unionByName(answers)
    let_go(docs.sparkSession)
    unseen = told.filter("part is null").select("to", F.lit(1).cast("long").alias("turn"), F.lit(None).cast("long").alias("more"),
                                                "w", F.col("uid").alias("n"))
    backed = _by_bucket(_words(model.counts, "more").unionByName(unseen), "to", "turn").mapInArrow(tidy(_back_off(known)), TOLD)
    backed = backed.withColumn("docs", F.lit(None).cast(f"array<{row_type}>"))
    sums = told.filter("part is not null").unionByName(backed).select("part", "turn", "start", "ids", "known", "base", "score", "docs")
    sums = _by_bucket(sums, "part", "turn", "start").mapInArrow(
        tidy(_sum_up(known)), f"row {row_type}, n_tokens long, n_known long, base_score double, score double")
    katz = F.struct("n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    return sums.select(*[F.col("row")[c].alias(c) for c in kept], katz.alias("katz"))


def _requests(known: Known):
    """The pairs of each batch, by bucket, with the documents that hold them; and a row of its documents and what is known of them."""
    routes = known.routes
    keys = fused(routes.hot_pairs[:, 0], routes.hot_pairs[:, 1])
    order = np.argsort(keys)
    keys, pairs_, pair_n = keys[order], routes.hot_pairs[order], known.pair_n[order]

    def run(batches):
        hashes, table, heads = Hashes(), Table(known), []

        def pairs():
            for b in batches:
                h, w, n = pairs_of(b.column(1).to_pylist(), hashes)
                batch, doc = b.column(2)[0].as_py(), np.repeat(np.arange(len(n)), n)
                # hot words count here, as do ends; the start is no token
                hot = place_in(routes.hot, h)
                counts = np.where((hot >= 0) & (h != START), known.hot_n[hot], -1)
                base = np.bincount(doc, np.where(counts >= 0, known.base(np.maximum(counts, 0)), 0.0), len(n)) + known.base(np.array([known.ends]))
                n_known = np.bincount(doc, counts > 0, len(n)).astype(np.int64) + (known.ends > 0)
                score_ = np.zeros(len(n))
                which = place_in(keys, fused(h, w))
                local = (which >= 0) & (pairs_[which, 0] == h) & (pairs_[which, 1] == w) if len(keys) else which >= 0
                if local.any():
                    # a hot pair of the sample is in the corpus, and its history is hot: all there is to know of it is known
                    c = pair_n[which[local]]
                    p = np.log10(known.pair_d[np.minimum(c, K + 2)] * c / table.over[place_in(table.histories, h[local])])
                    score_ += np.bincount(doc[local], p, len(n))
                    h, w, doc = h[~local], w[~local], doc[~local]
                heads.append(_head(batch, _pack((n, "<u8"), (n_known, "<u8"), (base, "<f8"), (score_, "<f8")), b.column(0)))
                # places in the partition of documents
                yield h, w, doc + (batch & (1 << ROW_BITS) - 1), np.full(len(n), batch)

        for h, w, doc, batch in _windows(pairs()):
            yield from heads
            row_type, first, wide = heads[0].column(heads[0].num_columns - 1).type.value_type, int(batch[0]), len(batch) >= 1 << 16
            heads.clear()
            bucket, h, w, m, doc = _distinct(h, w, routes, doc - (first & (1 << ROW_BITS) - 1))
            ends, out = np.cumsum(m), []
            for k, s, e in _slices(bucket):
                starts, runs = _runs(h[s:e])
                out.append((k, 2, first, *_pack((h[s:e][starts], "<u8"), (runs, "<u4")), _pack_words(w[s:e]),
                            *_pack((m[s:e], "<u4"), (doc[ends[s] - m[s]:ends[e - 1]], "<u4" if wide else "<u2")), bytes([wide]), None, None))
            for r in _records(iter(out), ASK):
                yield _with_docs(r, row_type)

    return run


def _with_docs(r: pa.RecordBatch, row: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*r.columns, pa.nulls(len(r), pa.list_(row))], [*r.schema.names, "docs"])


def _head(batch: int, numbers: list[bytes], rows: pa.Array) -> pa.RecordBatch:
    """A batch's documents and their numbers, which pass by the buckets."""
    r = next(_records(iter([(-1 - batch, 2, batch, *numbers, None, None, None, None)]), ASK))
    docs = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
    return pa.RecordBatch.from_arrays([*r.columns, docs], [*r.schema.names, "docs"])


def _answers(known: Known):
    """What a bucket knows of the pairs of each batch; unseen tokens go on to the buckets of their words."""
    routes = known.routes
    hot_p = np.log10(known.word_p(known.hot_n))

    def run(batches):
        table, at_bucket, counts, weights, unseen, held = None, None, [], [], [], 0
        row_type = None

        def send():
            w, uid = (np.concatenate([u[i] for u in unseen]) for i in range(2))
            order = np.argsort(w, kind="stable")
            w, uid = w[order], uid[order]
            for r in _records(((*[None] * 7, k, w[s:e].tobytes(), uid[s:e].astype("<i8").tobytes())
                               for k, s, e in _slices(routes.of_words(w))), TOLD):
                yield _with_docs(r, row_type)

        for b in batches:
            row_type = b.column(b.num_columns - 1).type.value_type
            for i, row in enumerate(zip(*[c.to_pylist() for c in b.columns[:-1]])):
                bucket, turn, batch = row[:3]
                if bucket < 0:
                    # the batch's own row goes through, first of its answers
                    r = next(_records(iter([(batch >> ROW_BITS, 1, batch & (1 << ROW_BITS) - 1, *row[3:7], None, None, None)]), TOLD))
                    yield pa.RecordBatch.from_arrays([*r.columns, b.column(b.num_columns - 1).slice(i, 1)], [*r.schema.names, "docs"])
                    continue
                if bucket != at_bucket:
                    table, at_bucket, counts, weights = None, bucket, [], []
                if turn < 2:
                    (weights if turn else counts).append(row)
                    continue
                if table is None:
                    table = Table(known, counts, weights)
                    counts, weights = [], []
                h, k, w, m = np.frombuffer(row[3], "<u8"), np.frombuffer(row[4], "<u4"), _words_of(row[5]), np.frombuffer(row[6], "<u4")
                doc = np.frombuffer(row[7], "<u4" if row[8][0] else "<u2").astype(np.int64)
                h, m = np.repeat(h, k), m.astype(np.int64)
                total, p, seen = table.look_up(h, w)
                hot_w = place_in(routes.hot, w)
                p = p + np.where(~seen & (hot_w >= 0), hot_p[hot_w], 0.0)
                own = place_in(routes.hot, h) < 0  # hot histories were counted with the batch
                each = np.repeat(np.arange(len(m)), m)
                ids, codes = np.unique(doc, return_inverse=True)
                sums = [np.bincount(codes, x[each], len(ids)) for x in (own & (total > 0), np.where(own, known.base(total), 0.0), p)]
                numbers = _pack((ids, "<u4"), (sums[0], "<u4"), (sums[1], "<f8"), (sums[2], "<f8"))
                r = next(_records(iter([(batch >> ROW_BITS, 0, batch & (1 << ROW_BITS) - 1, *numbers, None, None, None)]), TOLD))
                yield _with_docs(r, row_type)
                on = ~seen & (hot_w < 0)
                if on.any():
                    there = on[each]
                    unseen.append((w[each][there], batch + doc[there]))
                    held += len(unseen[-1][0])
                    if held > AT_ONCE:
                        yield from send()
                        unseen.clear()
                        held = 0
        if unseen:
            yield from send()

    return run


def _back_off(known: Known):
    """Unigram probabilities of tokens that were not seen after their history, summed by document."""
    def sums(uid: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        ids, codes = np.unique(uid, return_inverse=True)
        score_ = np.bincount(codes, np.log10(known.word_p(n)))
        for part, s, e in _slices(ids >> ROW_BITS):
            yield (part, 0, 0, (ids[s:e] & (1 << ROW_BITS) - 1).astype("<u4").tobytes(), None, None, score_[s:e].tobytes(), None, None, None)

    def run(batches):
        def out():
            for _, rows in _groups(batches):
                yield from _looked_up(rows, lambda _, uid, n: sums(np.frombuffer(uid, "<i8"), n))

        yield from _records(out(), TOLD)

    return run


def _sum_up(known: Known):
    """The numbers of each partition's documents, whose own rows come last."""
    def run(batches):
        at, n_known, base, score_ = None, *[np.zeros(0)] * 3
        for b in batches:
            for i, (part, turn, start, ids, *numbers) in enumerate(zip(*[c.to_pylist() for c in b.columns[:-1]])):
                if part != at:
                    at, (n_known, base, score_) = part, (np.zeros(0) for _ in range(3))
                if turn == 0:
                    to = start + np.frombuffer(ids, "<u4").astype(np.int64)
                    if to.max() >= len(base):
                        n_known, base, score_ = (np.concatenate([x, np.zeros(int(to.max()) + 1)]) for x in (n_known, base, score_))
                    for total, x, kind in zip((n_known, base, score_), numbers, ("<u4", "<f8", "<f8")):
                        if x is not None:
                            total[to] += np.frombuffer(x, kind)
                    continue
                n = np.frombuffer(ids, "<u8").astype(np.int64)
                own = [np.frombuffer(x, kind) for x, kind in zip(numbers, ("<u8", "<f8", "<f8"))]
                here = [np.pad(x[start:start + len(n)], (0, max(0, len(n) - len(x[start:start + len(n)])))) + y for x, y in zip((n_known, base, score_), own)]
                docs = b.column(b.num_columns - 1).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(n), pa.array(here[0].astype(np.int64)), pa.array(here[1]), pa.array(here[2])],
                    ["row", "n_tokens", "n_known", "base_score", "score"])

    return run
