import collections
import hashlib

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_alignment as op

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "Hello, world!", "Hello, world!", "two  spaces\n\nand\ttabs ", "naïve Übergröße 東京 🙂🙂",
         "<|endoftext|> and <s> as text", "don't stop " * 400, "x" * 3000, "ﬁne ½ ​ é", "12345 67890 " * 3]


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def brute(texts, tokenizers):
    """Links by the definition: all pairs of tokens whose byte ranges overlap."""
    a_model, b_model = tokenizers
    of = op.byte_alphabet()
    docs = []
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a_ids, b_ids = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_data = [bytes(of[c] for c in a_model.id_to_token(i)) for i in a_ids]
            b_data = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else
                      b_model.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
            if b"".join(a_data) == b"".join(b_data) == (" " + text).encode():
                ranges = lambda ids, data: [(i, sum(map(len, data[:k])), sum(map(len, data[:k + 1]))) for k, i in enumerate(ids)]
                a, b = ranges(a_ids, a_data), ranges(b_ids, b_data)
                links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
                at = 0
                for end in sorted({e for *_, e in a} & {e for *_, e in b}):
                    part = lambda side: ",".join(str(i) for i, s, e in side if at <= s and e <= end)  # noqa: E731, B023
                    groups.append(f"{part(a)}|{part(b)}")
                    at = end
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = collections.Counter(x for d in docs for x in d[3])
    best = collections.defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
            for a, b, g, links, groups in docs]


@pytest.mark.parametrize("shard,block", [(200_000, 4_000_000), (7, 20)])
def test_matches_brute_force(spark, tokenizers, monkeypatch, shard, block):
    monkeypatch.setattr(op, "SHARD_PAIRS", shard)
    monkeypatch.setattr(op, "BLOCK_PAIRS", block)
    monkeypatch.setattr(op, "FAN", 2)
    texts = [t[:200] if t else t for t in TEXTS]
    docs = spark.createDataFrame([(i, t, "x", i, "y") for i, t in enumerate(texts)], "doc_id int, text string, a string, row int, ids string")
    got = {r.doc_id: r for r in op.align(docs, A, B, public.PATTERN).collect()}
    assert set(next(iter(got.values())).asDict()) == {"doc_id", "a", "row", "ids", "alignment"}
    for i, want in enumerate(brute(texts, tokenizers)):
        assert tuple(got[i].alignment) == want, texts[i]


def test_nothing(spark):
    for rows in ([], [(None, None), (1, "")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert [tuple(r.alignment) for r in op.align(docs, A, B, public.PATTERN).collect()] == [(0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_tokenizer_a_is_the_file(tokenizers):
    own = op.ByteLevel(A, public.PATTERN)
    for text in TEXTS:
        assert own.encode(text or "") == tokenizers[0].encode(" " + (text or ""), add_special_tokens=False).ids


def test_tokenizer_b_in_parts(tokenizers, monkeypatch):
    monkeypatch.setattr(op, "PART", 16)
    own = op.Pieces(B)
    assert own.parts
    for text in [t for t in TEXTS if t] + ["ab  cd ef   gh ij kl mn op qr st uv wx yz  " * 9, "é a é b é c d e f g h i j k l m n o p"]:
        assert own.encode(text) == tokenizers[1].encode(text)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**62), max_size=400), st.lists(st.integers(0, 2**62), max_size=50))
def test_perfect_hash(keys, others):
    made = op.PerfectHash.build(np.array(sorted(keys), np.int64))
    again = op.PerfectHash.unpack(made.sizes, made.packed(), made.keys.tobytes())
    for h in (made, again):
        assert sorted(h.slots(np.array(sorted(keys), np.int64)).tolist()) == list(range(len(keys)))
        slots = h.slots(np.array(others, np.int64))
        assert [s >= 0 for s in slots] == [o in keys for o in others]


def test_query(spark, tokenizers):
    from tidemark.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_token_alignment"][0](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    short = [r for r in rows if len(r.text or "") < 600]
    for r, want in zip(short, brute([r.text for r in short], tokenizers)):
        row = got[r.doc_id]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links) == want[:4]
        assert row.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
        assert row.n_best <= row.n_links <= row.count_sum
