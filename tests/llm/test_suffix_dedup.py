import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import suffix_dedup as op
from tidemark.llm.queries import QUERIES


def brute(texts, length):
    """Removed spans of each text."""
    seen = collections.Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        starts = [p for p in range(len(t) - length + 1) if seen[t[p:p + length]] > 1]
        out.append(op.merged(starts, [p + length for p in starts]))
    return out


def corpus(seed, length):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [prose(length // 3) for _ in range(3)] + ["x" * (3 * length), "ab" * (2 * length)]
    texts = [prose(rnd.randint(0, 200)) for _ in range(20)]
    for _ in range(30):
        texts.append(prose(rnd.randint(0, 60)) + rnd.choice(passages)[rnd.randint(0, 9):] + prose(rnd.randint(0, 60)))
    base = prose(250).split(" ")
    for _ in range(12):
        near = list(base)
        for _ in range(3):
            near[rnd.randrange(len(near))] = "changed" + str(rnd.random())
        texts.append(" ".join(near))
    return [*texts, texts[0], texts[25], texts[25], "", None, "short", "short", "z" * (length - 1), "z" * (length - 1), "q" * length, "q" * length, "w" * (length + 1)]


def test_cover():
    assert all(any((i + d) % op.STEP in op.COVER and (j + d) % op.STEP in op.COVER for d in range(op.STEP))
               for i in range(op.STEP) for j in range(op.STEP))


@pytest.mark.parametrize("length", [32, 48, 400])
@pytest.mark.parametrize("seed", range(3))
def test_sorter(seed, length):
    rnd = random.Random(seed)
    block = bytes(rnd.choice(b"ab") for _ in range(2 * length))
    data = b"".join([bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 50))) + block[rnd.randint(0, 20):] for _ in range(12)]) + b"a" * (2 * length)
    seen = collections.Counter(data[p:p + length] for p in range(len(data) - length + 1))
    want = [p for p in range(len(data) - length + 1) if seen[data[p:p + length]] > 1]
    got = op.Sorter(np.frombuffer(data, np.uint8), length).repeated(np.arange(len(data) - length + 1))
    assert got.tolist() == want


def test_runs_depend_on_content_only():
    rnd = np.random.default_rng(2)
    passage = rnd.integers(97, 100, 700).astype(np.uint8)
    seen = []
    for before in (0, 13, 500):
        data = np.concatenate([rnd.integers(97, 100, before).astype(np.uint8), passage, rnd.integers(97, 100, 40).astype(np.uint8)])
        bucket, first, last = op.runs_of(data, np.ones(len(data), bool), 400, 32)
        of = {p: b for b, x, y in zip(bucket, first, last) for p in range(x, y + 1)}
        assert sorted(of) == list(range(len(data) - 399))
        seen.append([of[before + p] for p in range(301)])
    assert seen[0] == seen[1] == seen[2]


def test_long_texts_are_sketched_in_stretches(monkeypatch):
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 101, 9000).astype(np.uint8)
    offsets = np.array([0, 100, 5000, 5000, 9000])
    whole = op.sketch_batch(data, offsets, 400, 32)
    monkeypatch.setattr(op, "AT_ONCE", 1500)
    parts = op.sketch_batch(data, offsets, 400, 32)
    spread = lambda x: {(t, p): b for t, b, f, z in zip(*x) for p in range(f, z + 1)}
    assert spread(whole) == spread(parts) and len(spread(whole)) == 4900 - 399 + 4000 - 399


@pytest.mark.parametrize("seed, length, hot", [(1, 48, 20_000), (2, 48, 2), (3, 400, 20_000)])
def test_matches_brute_force(spark, seed, length, hot):
    texts = corpus(seed, length)
    docs = spark.createDataFrame([(i, t, "k", t) for i, t in enumerate(texts)], "doc_id long, text string, key string, starts string")
    rows = {r.doc_id: r for r in op.strip(docs, length=length, gram=16, hot_runs=hot).collect()}
    data = [(t or "").encode() for t in texts]
    for i, want in enumerate(brute(data, length)):
        got = rows[i].deduplicated
        assert [(s.start, s.stop) for s in got.spans] == want, (i, texts[i])
        keep = np.ones(len(data[i]), bool)
        for a, b in want:
            keep[a:b] = False
        assert bytes(got.kept) == bytes(np.frombuffer(data[i], np.uint8)[keep]) and got.n_bytes == len(data[i])


@pytest.mark.parametrize("limit", [0, 3000])
def test_large_buckets_are_counted(spark, monkeypatch, limit):
    real = op._sorted_buckets

    def limited(length):
        def sort(batches):
            batches = list(batches)
            sizes = pd.concat([b.assign(n=b["region"].str.len()) for b in batches]).groupby("bucket")["n"].sum() if batches else pd.Series([0])
            if sizes.max() > limit:
                raise ValueError(f"a bucket of {sizes.max()} bytes is sorted in one task")
            yield from real(length)(iter(batches))

        return sort

    monkeypatch.setattr(op, "_sorted_buckets", limited)
    # one passage in many different surroundings: a large bucket of few runs
    texts = corpus(4, 48) + [f"{k} " * 9 + "the same passage stands between " + f" {k}" * 9 for k in range(100, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in op.strip(docs, length=48, gram=16, hot_bytes=limit).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts], 48)):
        assert [(s.start, s.stop) for s in rows[i].deduplicated.spans] == want, (i, texts[i])


def test_buckets_keep_their_value_next_to_rows_without_one():
    bucket, passage = (1 << 60) + 1, bytes(range(256)) * 2
    runs = [{"first": 0, "last": 9, "bucket": bucket, "hot": False}, {"first": 10, "last": 11, "bucket": 7, "hot": True}]
    out = next(op._regions(400)(iter([pd.DataFrame({"key": [b"k"], "data": [passage], "runs": [runs]})])))
    assert [None if pd.isna(b) else int(b) for b in out["bucket"]] == [bucket, None, None]


def test_ids_that_repeat_or_are_null(spark):
    long = "some words of a longer text " * 20
    rows = [(None, long), (1, long + "x"), (1, long + "x"), (None, None), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text or "", bytes(r.deduplicated.kept)) for r in op.strip(docs).collect())
    spans = brute([(t or "").encode() for _, t in rows], 400)
    want = sorted((t or "", b"".join(bytes([b]) for p, b in enumerate((t or "").encode()) if not any(x <= p < y for x, y in s)))
                  for (_, t), s in zip(rows, spans))
    assert got == want
    assert op.strip(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    spans = dict(zip(docs, brute(list(docs.values()), 400)))
    for r in QUERIES["op9_suffix_dedup"][0](spark, sf).collect():
        data, own = docs[r.doc_id], spans[r.doc_id]
        kept, at = b"", 0
        for a, b in own:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), len(data) - len(kept), len(own))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
