import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import public_tokenizers as public
from tidemark.llm import bpe
from tidemark.llm.queries import QUERIES

PATH = public.path("byte_bpe_multi_50k.tiktoken")
VOC = bpe.Vocabulary.read(PATH)
ENC = bpe.Encoder(VOC, public.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=VOC.ranks, special_tokens={})
SAMPLES = ["", " ", "a", "it's we'll", "  two  spaces\n\n\n end ", "<|endoftext|>", "Éèç ñandú Größe 你好 🎉👩‍👩‍👧", "a" * 5000, "\n" * 3000 + "x",
           " \t  x", "x  y", "12345 678.90$$$###", "ab " * 3000, "\x1c\x85 z", "ends with space ", "'s 's't"]
ALPHABET = st.text(st.sampled_from(list("aeth nr's\n\t  12.,#éñ🎉 x")), max_size=60)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(text):
    assert ids(ENC.text(text)) == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ALPHABET, st.text(max_size=40)))
def test_any_text(text):
    assert ids(ENC.text(text)) == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=20), st.binary(max_size=20))
def test_appending_equals_encoding_anew(a, b):
    grown = bpe.Prefixes(VOC, a)
    before = list(grown.last)
    grown.append(b)
    assert grown.last[:len(a)] == before
    assert grown.tokens() == VOC.merged(a + b)
    assert all(bpe.Prefixes(VOC, (a + b)[:n]).tokens()[-1] == grown.last[n - 1] for n in range(1, len(a + b) + 1))


@settings(max_examples=200, deadline=None)
@given(ALPHABET, ALPHABET, st.integers(0, 60), st.integers(0, 60))
def test_edits(text, new, i, j):
    start, stop = sorted((min(i, len(text)), min(j, len(text))))
    t = bpe.Text(ENC, text)
    t.edit(start, stop, new)
    assert t.ids() == TIKTOKEN.encode_ordinary(text[:start] + new + text[stop:])


def test_pieces_go_on_from_stored_first_bytes(monkeypatch):
    seen = []
    real = bpe.Prefixes.append

    def append(self, data):
        seen.append(data)
        real(self, data)

    monkeypatch.setattr(bpe.Prefixes, "append", append)
    enc = bpe.Encoder(VOC, public.PATTERN)
    words = ["menteciónaa", "menteciónbo", "mentequxxz", "ñandúñandúz", "ñandúñanzz"]
    assert [ids(enc.text("x " + w)) for w in words] == [TIKTOKEN.encode_ordinary("x " + w) for w in words]
    assert seen.count(b" mente") == 1 and "ciónbo".encode() in seen


def test_edit_is_local():
    t = bpe.Text(ENC, "some words " * 2000)
    t.edit(11000, 11004, "other")
    assert t.encoded_again < 10


def test_small_vocabulary_with_unreachable_token():
    # "abc" is never made: neither "ab" + "c" nor "a" + "bc" are left when its turn comes
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abcb": 4, b"ab": 5}
    voc = bpe.Vocabulary(ranks)
    assert not voc.is_own(4) and voc.is_own(3)
    for text in (b"abcb", b"abab", b"abc", b"bcbcab", b"aabb"):
        assert bpe.Prefixes(voc, text).tokens() == voc.merged(text)


def test_rows_and_columns_stay(spark):
    rows = [(1, "same", b"x"), (1, "same", b"x"), (None, None, None), (2, "", b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data binary")
    out = bpe.round_trip(docs, PATH, public.PATTERN)
    got = sorted(((r.doc_id or 0, r.text or "", bytes(r.decoded).decode(), ids(r.ids)) for r in out.collect()), key=str)
    assert out.columns == ["doc_id", "text", "data", "ids", "decoded"]
    assert got == sorted(((d or 0, t or "", t or "", TIKTOKEN.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    assert bpe.round_trip(docs.limit(0), PATH, public.PATTERN).count() == 0
    arrays = out.select(bpe.as_array(F.col("ids")).alias("a")).collect()
    assert sorted(r.a for r in arrays) == sorted(x[3] for x in got)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op2_bpe"][0](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = TIKTOKEN.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(want)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
