import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explode as Ex, graph as G

GOLDEN = [(1, 4), (2, 1), (3, 1), (4, 2), (4, 3), (6, 5)]


def closure_model(seeds, edges):
    back = {}
    for s, d in edges:
        back.setdefault(d, set()).add(s)
    out = set()
    for seed in seeds:
        todo, seen = list(back.get(seed, ())), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(back.get(n, ()))
        out |= {(seed, n) for n in seen}
    return out


def run_closure(spark, seeds, edges, **kw):
    s = spark.createDataFrame([(x,) for x in seeds], "seed long")
    e = spark.createDataFrame(edges, "src long, dst long")
    return {tuple(r) for r in G.reverse_closure(s, e, **kw).collect()}


def test_cyclic_closure(spark):
    assert {n for _, n in run_closure(spark, [1], GOLDEN)} == {1, 2, 3, 4}
    assert run_closure(spark, [6], GOLDEN) == set()
    assert run_closure(spark, [5], GOLDEN) == {(5, 6)}


@pytest.mark.parametrize("seed, hops", [(1, 1), (2, 2), (3, 3)])
def test_random_closure(spark, seed, hops):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(30)]
    seeds = rnd.sample(range(25), 6)
    assert run_closure(spark, seeds, edges, doublings=hops, compact_every=2) == closure_model(seeds, edges)


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(30)]
    assert run_closure(spark, [30], chain, compact_every=3) == {(30, i) for i in range(30)}
    hub = [(i, 0) for i in range(1, 200)]
    assert run_closure(spark, [0], hub) == {(0, i) for i in range(1, 200)}


def links(spark, files, wanted, **kw):
    f = spark.createDataFrame([("v", x) for x in files], "vault string, path string")
    l = spark.createDataFrame([("v", x) for x in wanted], "vault string, link string")
    return {r["link"]: r["target"] for r in G.resolve_links(l, f, **kw).collect()}


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_resolve_links(spark, broadcast_rows):
    files = ["file.md", "another file.md", "other file.md", "md link.md", "inbox/another file.md", "pic.png"]
    got = links(spark, files, ["another file", "other file", "inbox/another file", "md link.md", "pic.png", "nope", "file", ""],
                broadcast_rows=broadcast_rows)
    assert got == {
        "another file": "another file.md", "other file": "other file.md", "inbox/another file": "inbox/another file.md",
        "md link.md": "md link.md", "pic.png": "pic.png", "file": "file.md", "": "file.md" if len("file.md") <= len("pic.png") else "pic.png"}


def test_suffix_without_border(spark):
    assert links(spark, ["15.md", "105.md"], ["5"]) == {"5": "15.md"}
    assert links(spark, ["15.md", "105.md", "a/5.md"], ["5"], strict=True) == {"5": "a/5.md"}


def exploded(spark, text):
    df = spark.createDataFrame([("/m/x.edn", text)], "id string, j string").select("id", F.parse_json("j").alias("doc"))
    return {r["id"]: r["d"] for r in Ex.explode_nested(df).select("id", F.to_json("doc").alias("d")).collect()}


def test_explode(spark):
    at = "/m/x.edn.explode/"
    assert exploded(spark, '{"a":"a","b":{"c":"c","d":{"e":"e","f":"f"}}}') == {
        f"{at}root.edn": f'{{"a":"a","b":"{at}b.edn"}}',
        f"{at}b.edn": f'{{"c":"c","d":"{at}b.d.edn"}}',
        f"{at}b.d.edn": '{"e":"e","f":"f"}'}
    assert exploded(spark, '{"a":1}') == {} == exploded(spark, "3")
    assert exploded(spark, '[{"a":1},2]') == {f"{at}root.edn": f'{{"0":"{at}0.edn","1":2}}', f"{at}0.edn": '{"a":1}'}
    assert exploded(spark, '{"l":[{"a":1},2]}') == {f"{at}root.edn": f'{{"l":["{at}l.0.edn",2]}}', f"{at}l.0.edn": '{"a":1}'}


def test_descendants(spark):
    docs = spark.createDataFrame([("/m/a/b.md",), ("/m/c.md",)], "id string")
    folders = spark.createDataFrame([("/m",), ("/m/a",), ("/x",)], "folder string")
    assert {tuple(r) for r in G.descendants(folders, docs).collect()} == {
        ("/m", "/m/a/b.md", 2), ("/m/a", "/m/a/b.md", 1), ("/m", "/m/c.md", 1)}


def reached_at(edges, seed, tx):
    """Plain search over the edges that hold after a transaction."""
    ahead = {}
    for s, d, a, b in edges:
        if a <= tx < b:
            ahead.setdefault(s, set()).add(d)
    todo, seen = list(ahead.get(seed, ())), set()
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo.extend(ahead.get(n, ()))
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_in_time(spark, seed):
    rng = random.Random(seed)
    # cycles, loops, long chains, repeated and overlapping intervals
    edges = [(rng.randrange(7), rng.randrange(7), a, a + rng.randrange(1, 9)) for a in (rng.randrange(20) for _ in range(40))]
    edges += [(n, n + 1, 3, 15 + n) for n in range(10, 18)] + [(18, 10, 5, G.FOREVER), edges[0]]
    table = spark.createDataFrame(edges, "src long, dst long, from_tx long, to_tx long")
    seeds = [0, 3, 10, 99]
    rows = G.closure_in_time(spark.createDataFrame([(x,) for x in seeds + [3]], "seed long"), table).collect()
    for tx in range(-1, 32):
        got = sorted((r.seed, r.node) for r in rows if r.from_tx <= tx < r.to_tx)
        assert got == sorted((s, n) for s in seeds for n in reached_at(edges, s, tx)), tx
    # the intervals of a pair neither overlap nor touch
    spans = sorted((r.seed, r.node, r.from_tx, r.to_tx) for r in rows)
    assert all(a[:2] != b[:2] or a[3] < b[2] for a, b in zip(spans, spans[1:]))


def test_a_round_in_time_does_not_write_what_was_visited_again(spark, monkeypatch):
    written, cut = [], G.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    # a long chain beside many short references
    edges = [(n, n + 1, 0, 9) for n in range(8)] + [(0, n, 0, 9) for n in range(100, 200)]
    rows = G.closure_in_time(spark.createDataFrame([(0,)], "seed long"), spark.createDataFrame(edges, "src long, dst long, from_tx long, to_tx long"))
    assert sorted(r.node for r in rows.collect()) == [*range(1, 9), *range(100, 200)]
    assert sum(written) <= 5 * len(edges)


def test_edges_in_time(spark):
    log = [("a", 1, "put", ["x", "y", "x", None]), ("a", 4, "put", ["x"]), ("a", 6, "delete", None), ("a", 9, "put", ["x"]),
           ("b", 2, "put", None), ("b", 3, "put", []), ("c", 5, "put", ["a"]), ("c", 7, "put", ["a", "b"])]
    edges = G.edges_in_time(spark.createDataFrame(log, "id string, tx_id long, op string, refs array<string>"), F.col("refs"))
    assert sorted(map(tuple, edges.collect())) == [
        ("a", "x", 1, 6), ("a", "x", 9, G.FOREVER), ("a", "y", 1, 4), ("c", "a", 5, G.FOREVER), ("c", "b", 7, G.FOREVER)]
    # without any versions there is nothing to reach
    none = G.closure_in_time(spark.createDataFrame([("a",)], "seed string"), edges.limit(0))
    assert none.columns == ["seed", "node", "from_tx", "to_tx"] and none.count() == 0


def test_a_document_leaves_python_as_one_row():
    import pandas as pd

    frame = pd.DataFrame({"id": ["a", "b", "c"], "doc": ['{"x": {"y": {"é": 1}}}', '{"x": 1}', None]})
    (out,) = Ex._pieces(iter([frame]))
    assert out["source"].tolist() == ["a"] and [p["path"] for p in json.loads(out["pieces"][0])] == ["x.y", "x", "root"]
