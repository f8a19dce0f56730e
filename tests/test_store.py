import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate as A, asof, merge as Mg, ordered as O, pull as Pl, queries as Q, store as St


@pytest.fixture(scope="module")
def events():
    """A log in which one id holds most versions."""
    rnd = random.Random(7)
    rows = []
    for tx in range(400):
        id_ = "hot" if rnd.random() < 0.7 else f"id{rnd.randrange(6)}"
        rows.append((tx, tx * 10, rnd.choice(["put", "put", "put", "delete"]), id_, rnd.randrange(4)))
    return rows


@pytest.fixture(scope="module")
def log(spark, events):
    return spark.createDataFrame(events, "tx_id long, tx_time long, op string, id string, v int")


@pytest.mark.parametrize("span", [1, 7, 50, 1 << 20])
def test_history_across_buckets(log, events, span):
    want, last = {}, {}
    for tx, t, *_rest in events:
        id_ = _rest[1]
        if id_ in last:
            want[last[id_]] = t
        last[id_] = tx
        want[tx] = None
    got = {r["tx_id"]: r["valid_to"] for r in St.history(log, span, 5).collect()}
    assert got == want


@pytest.mark.parametrize("span", [1, 9, 1 << 20])
def test_changes_across_buckets(log, events, span):
    prev, want = {}, set()
    for tx, _, op, id_, v in events:
        state = v if op == "put" else None
        if id_ not in prev or prev[id_] != state:
            want.add((tx, id_ not in prev))
        prev[id_] = state
    got = St.history_changes(log, F.when(F.col("op") == "put", F.col("v")), span, 5)
    assert {(r["tx_id"], r["is_first"]) for r in got.collect()} == want


@pytest.mark.parametrize("span", [1, 11, 1 << 20])
def test_as_of_join_across_buckets(log, events, span):
    left, right = log.filter("v < 2"), log.filter("v >= 2")
    out = asof.as_of_join(left.select("id", "tx_id"), right, "id", "tx_id", O.tx_bucket(F.col("tx_id"), span), {"r": "tx_id"}, hot_rows=5)
    want = {}
    for tx, _, _, id_, v in events:
        if v < 2:
            want[tx] = max((t for t, _, _, i, w in events if i == id_ and w >= 2 and t <= tx), default=None)
    assert {r["tx_id"]: r["r"] for r in out.collect()} == want


def test_running_sum(log, events):
    out = O.with_running_sum(log, ["id"], ["tx_id"], O.tx_bucket(F.col("tx_id"), 13), "v", "s", 5)
    want, acc = {}, {}
    for tx, _, _, id_, v in events:
        acc[id_] = acc.get(id_, 0) + v
        want[tx] = acc[id_]
    assert {r["tx_id"]: r["s"] for r in out.collect()} == want


@pytest.mark.parametrize("at", [0, 57, 399])
def test_as_of(log, events, at):
    state = {}
    for tx, _, op, id_, v in events:
        if tx <= at:
            state[id_] = (tx, v) if op == "put" else None
    want = {i: s for i, s in state.items() if s}
    assert {r["id"]: (r["tx_id"], r["v"]) for r in St.as_of(log, tx_id=at).collect()} == want


def test_entity_and_log_from(log, events):
    assert St.entity(log, "nobody").count() == 0
    assert St.log_from(log, 390).count() == 10


def test_valid_history(spark):
    rows = [(1, 100, None, "a"), (2, 200, 50, "a"), (3, 300, None, "a"), (4, 400, None, "b")]
    df = spark.createDataFrame(rows, "tx_id long, t long, v long, id string").select(
        "tx_id", "id", F.lit("put").alias("op"), F.timestamp_seconds("t").alias("tx_time"),
        F.timestamp_seconds("v").alias("valid_time"))
    for per_bucket in (1, 100):
        out = St.valid_history(df, per_bucket).select(
            "tx_id", F.unix_seconds("valid_from").alias("f"), F.unix_seconds("valid_to").alias("t"))
        assert {tuple(r) for r in out.collect()} == {(2, 50, 100), (1, 100, 300), (3, 300, None), (4, 400, None)}


def test_normalise(spark):
    rows = [(1, "put", None, None, None), (2, "delete", None, True, None), (3, "put", 5, None, None),
            (4, "put", None, False, None), (5, "evict", None, None, None), (6, "put", None, None, True)]
    df = spark.createDataFrame(rows, "tx_id int, op string, valid_time int, committed boolean, ignore boolean")
    assert [r["tx_id"] for r in St.normalise_ops(df).orderBy("tx_id").collect()] == [1, 2]


def test_document_lifecycle(spark):
    """Content and sidecar come and go; the document exists while either does."""
    mk = lambda rows: spark.createDataFrame(rows, "id string, modified int")
    step = lambda seen, stored: {tuple(r) for r in St.sync_ops(mk(seen), mk(stored)).select("id", "op", "modified").collect()}
    assert step([("/t/f", 1)], []) == {("/t/f", "put", 1)}
    assert step([("/t/f", 1), ("/t/f", 2)], [("/t/f", 1)]) == {("/t/f", "put", 2)}
    assert step([("/t/f", 2)], [("/t/f", 2)]) == set()
    assert step([], [("/t/f", 2)]) == {("/t/f", "delete", None)}


def test_overlay_precedence(spark):
    content = spark.createDataFrame([("a", 1, 1, 1), ("b", 5, 1, 1)], "id string, modified int, one int, two int")
    side = spark.createDataFrame([("a", 3, 2, ["one"]), ("b", 2, None, ["one"]), ("c", 1, 9, ["one"])],
                                 "id string, modified int, one int, keys array<string>")
    got = {r["id"]: (r["modified"], r["one"], r["two"]) for r in Mg.overlay_sidecar(content, side, ["one", "two"]).collect()}
    assert got == {"a": (3, 2, 1), "b": (5, None, 1), "c": (1, 9, None)}


def test_merge_documents(spark):
    rows = [("a", 0, '{"x":1,"y":{"p":1}}'), ("a", 1, '{"y":{"q":2},"z":null}'), ("b", 0, '{"k":[1]}')]
    df = spark.createDataFrame(rows, "id string, prio int, j string").select("id", "prio", F.parse_json("j").alias("doc"))
    got = {r["id"]: r["d"] for r in Mg.merge_documents(df).select("id", F.to_json("doc").alias("d")).collect()}
    assert got == {"a": '{"x":1,"y":{"q":2},"z":null}', "b": '{"k":[1]}'}


@pytest.mark.parametrize("hot", [5, 1000])
def test_median(spark, hot):
    rnd = random.Random(3)
    rows = [(k, float(rnd.randrange(50)) / 4) for k in "aab" for _ in range(rnd.randrange(5, 60))] + [("c", 1.0), ("c", 2.0)]
    got = {r["k"]: r["median"] for r in A.median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 2.0, hot).collect()}
    import statistics

    assert got == {k: statistics.median(v for q, v in rows if q == k) for k in "abc"}


@pytest.mark.parametrize("hot", [10, 1000])
def test_numbered_items_have_one_shape_at_every_size(spark, hot):
    rows = [("hot", 2 * i) for i in range(95)] + [("cold", i) for i in range(5)] + [(None, i) for i in range(20)]
    out = Pl.numbered(spark.createDataFrame(rows, "k string, c long"), ["k"], ["c"], F.floor(F.col("c") / 7), hot_rows=hot).collect()
    want = {(k, p, c) for key in ("hot", "cold", None) for p, (k, c) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1)}
    assert {(r["k"], r["pos"], r["c"]) for r in out} == want and len(out) == len(rows)


def test_the_null_group_has_a_median(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 5.0)]
    for hot in (1, 1000):
        got = A.median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 1.0, hot).collect()
        assert {(r["k"], r["median"]) for r in got} == {(None, 2.0), ("a", 5.0)}


def test_updates_of_unknown_documents_fail(spark):
    docs = spark.createDataFrame([("a", "x")], "id string, v string")
    updates = spark.createDataFrame([("b", ["v"], "y")], "id string, keys array<string>, v string")
    with pytest.raises(Exception, match="no document to update: b"):
        St.upsert(docs, updates, ["v"]).collect()


def test_as_of_reads_only_what_is_asked(spark, log):
    slim = St.as_of(log, columns=[])
    assert set(slim.columns) == {"id", "tx_id"}
    plan = St.as_of(log)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("span", [2, 1 << 20])
def test_entity_query_changes(spark, log, events, span):
    """One pass over the log names the transactions after which re-running the query differs."""
    grouped = log.withColumn("g", F.floor(F.col("tx_id") / 10).cast("long"))
    got = {r["tx_id"] for r in Q.entity_query_changes(grouped, "g", F.col("v") == 2, [F.col("v")], span, 5).collect()}
    state, before, want = {}, frozenset(), set()
    for g in range(40):
        for tx, _, op, id_, v in events[g * 10:(g + 1) * 10]:
            state[id_] = v if op == "put" else None
        after = frozenset(i for i, v in state.items() if v == 2)
        if after != before:
            want.add(g)
        before = after
    assert got == want


def test_result_changes(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert {tuple(r) for r in Q.result_changes(a, b).collect()} == {(1, "removed", 1), (2, "removed", 1), (3, "added", 1)}
    assert not Q.has_changed(a, a)


def test_append_is_idempotent(spark, tmp_path):
    ops = spark.createDataFrame([("a", "put")], "id string, op string")
    for _ in range(2):
        St.append_ops(ops, str(tmp_path / "log"), 1, F.lit(5))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
