import itertools
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as op
from tidemark.llm.components import components, stars
from tidemark.llm.queries import QUERIES


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(values, near):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if near(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= 4


def test_triples_cover_every_difference():
    for spread in itertools.product(range(5), repeat=6):
        if sum(spread) <= 4:
            assert any(sum(spread[i] for i in t) <= 1 for t in op.TRIPLES)


def test_anchors_cover():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 1 << 31, 2000, dtype=np.uint64)
    s = op.syndrome(word)
    home = op.flipped(word, s)
    assert (op.syndrome(home) == 0).all() and (np.bitwise_count(word ^ home) <= 1).all()
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    visits = [set() for _ in fp]
    for anchor in op.homes_of(fp):
        for k, a in enumerate(anchor.tolist()):
            visits[k].add(a)
    for rows, anchor in op.visits_of(fp):
        for k, a in zip(rows.tolist(), anchor.tolist()):
            visits[k].add(a)
    other = fp.copy()
    for k in range(len(fp)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    homes = np.stack(list(op.homes_of(other)))
    assert all(visits[k] & set(homes[:, k].tolist()) for k in range(len(fp)))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "a b c", "A b c d", "x " * 70000 + "y", "Éa b c d e É"])
def test_fingerprint(text):
    assert op.fingerprint_of(text.encode() if text else None) & (1 << 64) - 1 == slow_fingerprint(text)


def cluster(rnd, n, flips):
    base = rnd.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = base
        for b in rnd.sample(range(64), rnd.randint(1, flips)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("hot_homes", [1024, 3])
def test_links_connect_what_brute_force_connects(spark, hot_homes):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(150)} | cluster(rnd, 120, 5) | cluster(rnd, 60, 3) | {0, 1, 15, (1 << 64) - 1}
    chain = rnd.getrandbits(64)
    for k in range(16):
        values.add(chain)
        for b in range(4):
            chain ^= 1 << (4 * k + b)
    values = sorted(signed(v) for v in values)
    edges = op.links(spark.createDataFrame([(v,) for v in values], "fp long"), hot_homes=hot_homes)
    got = {v: v for v in values} | {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == groups_of(values, near)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (300, 200), (300, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)} | {300: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    node, root = stars(np.array([5, 5, 9]), np.array([3, 8, 10]))
    assert dict(zip(node.tolist(), root.tolist())) == {5: 3, 8: 3, 10: 9}


DOCS = [(1, "a b c d e f g"), (2, "A  b c\td e f g"), (3, "other words stand in this text"), (3, "other words stand in this text"),
        (None, None), (4, ""), (None, "only one without id"), (None, "only one without id"), (5, "a b c d e f g"), (3, "a b c d e f g")]


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(i, t, i, t, 0) for i, t in DOCS], "doc_id long, text string, root long, component_id string, fp int")
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a b c d e f g"), (3, "other words stand in this text"), (4, ""), (None, "only one without id")], key=str)
    assert op.keep_one(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: slow_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = groups_of(sorted(docs), lambda a, b: near(docs[a], docs[b]))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"][0](spark, sf).collect()}
    assert got == {d: (f"{docs[d]:016x}", groups[d]) for d in docs}


def test_keep_one_with_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x", "y", 7, "z"), (2, "a b c d e f", "p", "q", 8, "r"), (3, "something else entirely here now", "u", "v", 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __hash_of string, root int, row string")
    assert sorted(map(tuple, op.keep_one(docs).collect())) == [rows[0], rows[2]]
