"""Byte-level BPE encoding and decoding by prefix dynamic programming.

In byte-pair encoding the encoding of every prefix of a byte string ends in exactly
one token, and dropping that token leaves the encoding of a shorter prefix. So a
string is described by one array: the last token of each of its prefixes. The array
grows by one entry per byte: among the tokens that end at the new byte, longest
first, the right one is the first that may stand after the last token before it.
Two tokens may stand side by side when encoding their joined bytes gives just them
back; that is decided once per pair and remembered.

Appending therefore never changes what is stored, and an edit only asks for the
pieces whose split can have changed (``Text.edit``). Words go on from the stored
entries of their first bytes (``Encoder.stems``).

Texts are cut into the matches of ``pattern``, each encoded on its own without
special tokens; a match that is a token as a whole is that token. Null is the empty
text, which has no tokens. Unknown ids decode to an error.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bounded_batches, give_back

# Words, pieces and pairs a task remembers; beyond this the oldest half goes.
MEMORY = 250_000
PAIRS = 250_000
# Of so many first bytes of a piece the entries are remembered, for so many different ones.
STEM = 6
STEMS = 100_000
NEVER = 1 << 60
# A space before white space or the end, where a match need not start.
BLANKS = regex.compile(r" (?:\s|\Z)")
# A pattern match cannot depend on characters further right than this beyond its end.
LOOKAHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of byte strings; a lower rank is merged earlier."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        # finds all tokens that end at a byte, longest first
        self.ends = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()
        self._spines: dict[int, tuple[list[int], list[int]] | None] = {}
        # bytes by id
        self.table = np.array([self.bytes.get(i) for i in range(max(self.bytes) + 1)], object)

    @staticmethod
    def read(path: str) -> "Vocabulary":
        return Vocabulary(read_ranks(path))

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """Encoding by the definition: merge the leftmost pair of lowest rank until none is left or few parts are."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > until:
            best = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best[0] == NEVER:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``; None for a single byte. Raises if encoding never makes it."""
        data = self.bytes[token]
        if len(data) == 1:
            return None
        ids = self.merged(data, until=2)
        if len(ids) != 2 or self.ranks.get(data) != token or max(ids) >= token:
            raise KeyError(token)
        return ids[0], ids[1]

    def spines(self, token: int) -> tuple[list[int], list[int]] | None:
        """Tokens at the left and the right end of ``token`` while it is merged, newest first; None if it never is.

        Merging goes by rising rank, as a token's parts have lower ranks than itself.
        """
        if token in self._spines:
            return self._spines[token]
        try:
            halves = self.parts(token)
            if halves is None:
                known = [token], [token]
            else:
                known = [token, *self.spines(halves[0])[0]], [token, *self.spines(halves[1])[1]]
        except (KeyError, TypeError):
            known = None
        self._spines[token] = known
        return known

    def is_own(self, token: int) -> bool:
        """Whether encoding the token's bytes gives the token; others never end a prefix."""
        return self.spines(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` within a piece: no merge ever joins them across their border.

        At every moment the border lies between one token of the left one's right spine
        and one of the right one's left spine. Joining those two must never be the next
        merge: it must come after the merge that replaces either of them.
        """
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            after = self.spines(right)
            known = self.pairs[pair] = after is not None and self._apart(self.spines(left)[1], after[0])
        return known

    def _apart(self, a: list[int], b: list[int]) -> bool:
        rank, of = self.ranks.get, self.bytes
        i, j = len(a) - 1, len(b) - 1
        while True:
            next_a = a[i - 1] if i else NEVER
            next_b = b[j - 1] if j else NEVER
            joined = rank(of[a[i]] + of[b[j]], NEVER)
            # of two equal merges the left one goes first
            if joined < next_a and joined <= next_b and joined != NEVER:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i -= 1
            else:
                j -= 1


class Prefixes:
    """The last token of every prefix of one growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", stem: bytes = b"", known: tuple[int, ...] = ()):
        """``known``: what is stored of ``stem``, to which ``data`` is appended."""
        self.vocabulary, self.data, self.last = vocabulary, stem, list(known)
        self.append(data)

    def append(self, data: bytes) -> None:
        voc, last, start = self.vocabulary, self.last, len(self.data)
        self.data += data
        # a token that ends at a new byte begins no earlier than here
        base = max(0, start - voc.longest + 1)
        fits, pairs, own, put, n = voc.fits, voc.pairs.get, voc._spines.get, last.append, len(last)
        due = n - base
        for end, (token, length) in voc.ends.iter(self.data[base:].decode("latin-1")):
            if end < due:
                continue
            if end > due:
                break
            begin = n + 1 - length
            if begin:
                left = last[begin - 1]
                good = pairs((left, token))
                if good is None:
                    good = fits(left, token)
            else:
                good = own(token) or voc.is_own(token)
            if good:
                put(token)
                n += 1
                due += 1
        if len(last) != len(self.data):
            raise ValueError(f"no token for byte {self.data[len(last)]}")

    def tokens(self) -> list[int]:
        """The encoding, read backwards from the last prefix."""
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


def encode_piece(voc: Vocabulary, data: bytes, stems: dict[bytes, tuple[int, ...]]) -> list[int]:
    """One match of the pattern; ``stems`` has the entries of first bytes seen before, and gets these."""
    whole = voc.ranks.get(data)
    if whole is not None:
        return [whole]
    if len(data) <= STEM:
        return Prefixes(voc, data).tokens()
    stem = data[:STEM]
    known = stems.get(stem)
    if known is None:
        if len(stems) >= STEMS:
            stems.clear()
        known = stems[stem] = tuple(Prefixes(voc, stem).last)
    return Prefixes(voc, data[STEM:], stem, known).tokens()


class Encoder:
    """Whole texts, with a bounded memory of words and pieces already encoded."""

    def __init__(self, voc: Vocabulary, pattern: str):
        self.voc, self.split = voc, regex.compile(pattern).findall
        # words and matches seen lately, and those from before
        self.known: dict[str, bytes] = {}
        self.old_known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.stems: dict[bytes, tuple[int, ...]] = {}
        # " x" always starts a match of a pattern whose word classes take one space before them
        self.by_words = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" in pattern
        # nothing but the letter class matches a space and letters, so no match ends among them
        self.by_letters = self.by_words and all(a.startswith("'") for a in pattern.split(r"| ?\p{L}+|")[0].split("|"))

    def forget(self) -> None:
        """Let all remembered words, pieces and pairs go."""
        for memory in (self.known, self.old_known, self.pieces, self.old_pieces, self.stems, self.voc.pairs):
            memory.clear()

    @staticmethod
    def remember(young: dict[str, bytes], old: dict[str, bytes], key: str, make) -> bytes:
        """What ``key`` stands for, from the older memory or made anew; what is used stays among the young."""
        ids = old.get(key) or make(key)
        if len(key) <= 64:
            if len(young) >= MEMORY:
                old.clear()
                old.update(young)
                young.clear()
            young[key] = ids
        return ids

    def encode(self, piece: str) -> bytes:
        ids = encode_piece(self.voc, piece.encode(), self.stems)
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        """The ids of a match, as little-endian unsigned 32-bit integers."""
        return self.pieces.get(piece) or self.remember(self.pieces, self.old_pieces, piece, self.encode)

    def word(self, word: str) -> bytes:
        """The ids of a word and the space before it; the matches after the first begin without a space."""
        # letters of blocks that are the same in all versions of Unicode
        if self.by_letters and word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self.encode(" " + word)
        first, *rest = self.split(" " + word)
        start = first[1:]
        if not rest:
            return self.encode(first)
        known = self.known.get(start) or self.remember(self.known, self.old_known, start, lambda _: self.encode(first))
        return known + b"".join([self.piece(p) for p in rest])

    def words(self, text: str) -> bytes:
        return b"".join([self.piece(p) for p in self.split(text)])

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or BLANKS.search(text):
            return self.words(text)
        # no blank follows another one's right side, so each space starts a match
        first, *rest = text.split(" ")
        known, old, remember, word = self.known, self.old_known, self.remember, self.word
        return b"".join([self.words(first), *[known.get(w) or remember(known, old, w, word) for w in rest]])


class Text:
    """An encoded text that can be edited; only pieces near an edit are encoded again."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.pieces = [(p, encoder.piece(p)) for p in encoder.split(text)]
        self.encoded_again = len(self.pieces)

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(i for _, i in self.pieces), "<u4").tolist()

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters [start, stop) by ``new``."""
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep][0]) + LOOKAHEAD <= start:
            at += len(self.pieces[keep][0])
            keep += 1
        rest = "".join(p for p, _ in self.pieces[keep:])
        text = rest[:start - at] + new + rest[stop - at:]
        # old piece borders right of the edit, as places in the new text
        borders, place = {}, at
        for k in range(keep, len(self.pieces) + 1):
            if place >= stop:
                borders[place - at - (stop - start) + len(new)] = k
            if k < len(self.pieces):
                place += len(self.pieces[k][0])
        fresh, tail = [], len(self.pieces)
        for match in regex.finditer(self.encoder.split.__self__.pattern, text):
            if match.start() >= start - at + len(new) and match.start() in borders:
                tail = borders[match.start()]
                break
            fresh.append((match[0], self.encoder.piece(match[0])))
        self.encoded_again = len(fresh)
        self.pieces[keep:tail] = fresh


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary.read(path)


def encode(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text as packed little-endian unsigned 32-bit integers.

    ``path`` is the rank file; it has to be at that place on every machine.
    """
    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(_vocabulary(path), pattern)
        for batch in batches:
            yield pd.Series([encoder.text(t) for t in batch], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes of packed ids; null stays null."""
    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = {i: b for b, i in read_ranks(path).items()}
        table = [of.get(i) for i in range(max(of) + 1)]
        for batch in batches:
            yield pd.Series([None if b is None else b"".join([table[i] for i in np.frombuffer(b, "<u4").tolist()])
                             for b in batch], dtype=object)

    return data(ids)


def n_tokens(ids: Column) -> Column:
    return F.floor(F.length(ids) / 4).cast("bigint")


def as_array(ids: Column) -> Column:
    """Packed ids as an array of numbers."""
    @F.pandas_udf("array<bigint>")
    def unpacked(batch: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, "<u4").astype("int64") for b in batch], dtype=object)

    return unpacked(ids)


def encode_and_decode(text: Column, path: str, pattern: str) -> Column:
    """A struct of the packed ids of each text and the bytes that the rank file decodes them to, in one pass through Python."""
    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        encoder = Encoder(_vocabulary(path), pattern)
        table = encoder.voc.table
        try:
            for batch in batches:
                ids = [encoder.text(t) for t in batch]
                yield pd.DataFrame({"ids": ids, "decoded": [b"".join(table[np.frombuffer(b, "<u4")].tolist()) for b in ids]}, dtype=object)
        finally:
            encoder.forget()
            give_back()

    return both(text)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the columns ``ids`` (packed) and ``decoded`` (bytes); every row and other column stays, unless it has such a name."""
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    coded = docs.select(row.alias("row"), encode_and_decode(F.col(text), path, pattern).alias("coded"))
    return coded.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in (ids, decoded)],
                        F.col("coded.ids").alias(ids), F.col("coded.decoded").alias(decoded))


