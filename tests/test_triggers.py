import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import schedule as Sc, triggers as Tr

TRIG = "self_id string, on_k string, idx int, is_vector boolean, glob string"
OPS = "tx_id long, op_seq long, op string, id string"


def test_all_kinds(spark):
    """One document carries every trigger; two documents it refers to are written."""
    me = "/test/me.md"
    kinds = ["modify", "refs", "pattern", "startup", "tx", "query", "shutdown"]
    trig = spark.createDataFrame([(me, k, 0, False, "/test/**/*.md" if k == "pattern" else None) for k in kinds]
                                 + [(me, "pattern", 1, False, "/test/*.md")], TRIG)
    ops = spark.createDataFrame([(0, 0, "put", me), (1, 1, "put", "/test/one.md"), (2, 2, "put", "/test/folder/two.md"),
                                 (3, 3, "delete", "/test/one.md")], OPS)
    closure = spark.createDataFrame([("/test/one.md", me), ("/test/folder/two.md", me)], "seed string, node string")
    changes = spark.createDataFrame([(1, me, 0)], "tx_id long, self_id string, idx int")
    rows = Tr.in_order(Tr.compute_firings(ops, trig, closure, changes)).collect()
    count = {k: sum(r["on_k"] == k for r in rows) for k in kinds}
    assert count == {"modify": 1, "refs": 2, "pattern": 4, "startup": 1, "tx": 4, "query": 1, "shutdown": 0}
    assert {r["target_id"] for r in rows if r["on_k"] == "refs"} == {"/test/one.md", "/test/folder/two.md"}
    gone = [r for r in rows if r["tx_id"] == 3 and r["on_k"] == "pattern"]
    assert [r["target_id"] for r in gone] == [None]
    assert [(r["tx_id"], r["rank"]) for r in rows] == sorted((r["tx_id"], r["rank"]) for r in rows)
    runs = spark.createDataFrame([(7,)], "tx_id long")
    assert [r["target_id"] for r in Tr.fire_lifecycle(runs, trig, "shutdown").collect()] == [me]
    assert {r["on_k"]: r["n"] for r in Tr.frequencies(Tr.compute_firings(ops, trig)).collect()} == {
        "modify": 1, "pattern": 4, "startup": 1, "tx": 4}


def test_versions_of_triggers(spark):
    trig = spark.createDataFrame([("/a", "modify", 0, False, None, 0, 2), ("/a", "modify", 1, True, None, 2, None)],
                                 TRIG + ", from_tx long, to_tx long")
    ops = spark.createDataFrame([(t, t, "put", "/a") for t in range(4)], OPS)
    got = {(r["tx_id"], r["on_path"]) for r in Tr.fire_self(ops, trig, "modify").collect()}
    assert got == {(0, "tide.on/modify"), (1, "tide.on/modify"), (2, "tide.on/modify/1"), (3, "tide.on/modify/1")}


def test_specs_and_predicate(spark):
    docs = spark.createDataFrame([("/a", '[{"call":1},{"doit":true,"call":2},3]'), ("/b", "4")], "id string, j string")
    specs = Tr.expand_specs(docs.select("id", F.parse_json("j").alias("v")), "foo", F.col("v"))
    chosen = specs.filter(F.coalesce(F.try_variant_get("spec", "$.doit", "boolean"), F.lit(False)) | (F.col("self_id") == "/b"))
    got = {(r["self_id"], r["p"]) for r in chosen.select(
        "self_id", Tr.on_path(F.lit("foo"), F.col("idx"), F.col("is_vector")).alias("p")).collect()}
    assert got == {("/a", "tide.on/foo/1"), ("/b", "tide.on/foo")}


def test_glob_join_equals_pairs(spark):
    ids = ["/a/b.md", "/a/c/d.md", "/b/x.log", "/a", "rel.md"]
    globs = ["**", "*", "/a/*", "/a/**", "**.md", "/b/*.log", "/*/[bx]*", "rel.*", "/c/**"]
    i = spark.createDataFrame([(x,) for x in ids], "id string")
    g = spark.createDataFrame([(x,) for x in globs], "glob string")
    from tidemark.functions.paths import glob_regex

    pairs = i.join(g, F.call_function("rlike", F.col("id"), glob_regex(F.col("glob"))), "inner")
    assert {tuple(r) for r in Tr.match_globs(i, g).collect()} == {tuple(r) for r in pairs.collect()}


def test_registry(spark):
    reg = Tr.Registry()
    reg.register("audit", 99, lambda ops, trig: ops.filter("op = 'delete'").select(
        "tx_id", "op_seq", F.lit("/audit").alias("self_id"), F.lit(0).alias("idx"), F.lit("x").alias("on_path"),
        F.col("id").alias("target_id")))
    with pytest.raises(ValueError):
        reg.register("tx", 1, None)
    ops = spark.createDataFrame([(1, 1, "delete", "/a"), (1, 2, "put", "/b")], OPS)
    trig = spark.createDataFrame([], TRIG)
    rows = Tr.compute_firings(ops, trig, registry=reg).collect()
    assert [(r["on_k"], r["rank"], r["target_id"]) for r in rows] == [("audit", 99, "/a")]


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def test_every_is_cut_into_runs(spark, monkeypatch):
    monkeypatch.setattr(Sc, "TICKS_PER_ROW", 7)
    df = spark.createDataFrame([(0, 100_500, 1), (0, 0, 1), (5_000, 6_000, 3)], "start long, end long, every_ms long")
    rows = sorted((r["start"], r["n"], r["at"]) for r in Sc.expand_every(df).collect())
    assert rows == [(0, n, n * 1000) for n in range(101)] + [(5_000, 0, 5_000)]


@pytest.mark.parametrize("cron, n, first", [
    ("0 * * * *", 72, us(2024, 1, 1)), ("30 9 * * 1-5", 3, us(2024, 1, 1, 9, 30)), ("*/20 1-2 * * *", 18, us(2024, 1, 1, 1)),
    ("0 0 2 * *", 1, us(2024, 1, 2)), ("0 0 2 * WED", 2, us(2024, 1, 2)), ("5 4 * FEB *", 0, None), ("0 0 * * 7", 0, None),
    ("0 0 * * TUE,WED", 2, us(2024, 1, 2)), ("10/25 0 1 1 *", 2, us(2024, 1, 1, 0, 10)), ("not a cron", 0, None),
])
def test_cron(spark, cron, n, first):
    df = spark.createDataFrame([(us(2024, 1, 1), us(2024, 1, 4), cron)], "start long, end long, cron string")
    at = sorted(r["at"] for r in Sc.expand_cron(df).collect())
    assert len(at) == n and (at[0] if at else None) == first


def test_triggers_of_documents_in_a_log(spark):
    """Specs of every version, live until the next put or delete of their document."""
    rows = [
        (1, "put", "a", '{"tide.on/modify": {"call": "x", "p": 1}, "tide.on/pattern": [{"glob": "/m/*"}, "f"]}'), (2, "put", "b", '{"q": 1}'),
        (3, "put", "a", '{"tide.on/query": {"q": "all"}, "tide.on/tx": [":sh", "echo"]}'), (5, "delete", "a", None), (6, "put", "b", '{"tide.on/startup": null}')]
    log = spark.createDataFrame(rows, "tx_id long, op string, id string, j string").withColumn("doc", F.try_parse_json("j")).drop("j")
    got = {(r["self_id"], r["on_k"], r["idx"], r["is_vector"], r["glob"], r["spec"], r["has_call"], r["from_tx"], r["to_tx"])
           for r in Tr.triggers_of(log).collect()}
    assert got == {
        ("a", "modify", 0, False, None, '{"call":"x","p":1}', True, 1, 3), ("a", "pattern", 0, True, "/m/*", '{"glob":"/m/*"}', False, 1, 3),
        ("a", "pattern", 1, True, None, '"f"', True, 1, 3), ("a", "query", 0, False, None, '{"q":"all"}', False, 3, 5),
        ("a", "tx", 0, True, None, '[":sh","echo"]', True, 3, 5)}


def test_firings_say_what_to_call(spark):
    rows = [(1, "put", "a", '{"tide.on/schedule": {"every": 5, "call": "t"}, "tide.on/query": {"q": "all", "call": "c"}}'), (4, "put", "a", "{}")]
    log = spark.createDataFrame(rows, "tx_id long, op string, id string, j string").withColumn("doc", F.try_parse_json("j")).withColumn(
        "op_seq", F.lit(0).cast("long"))
    ticks = spark.createDataFrame([("a", 0, 1, 77), ("a", 0, 4, 88)], "self_id string, idx int, tx_id long, ts long")
    changes = spark.createDataFrame([(2, "a", 0, "h")], "tx_id long, self_id string, idx int, results_hash string")
    got = Tr.compute_firings(log.select("tx_id", "op_seq", "op", "id"), Tr.triggers_of(log), query_changes=changes, ticks=ticks)
    assert [(r["tx_id"], r["rank"], r["on_k"], json.loads(r["spec"])["call"], r["results_hash"], r["ts"]) for r in Tr.in_order(got).collect()] == [
        (1, 9, "schedule", "t", None, 77), (2, 7, "query", "c", "h", None)]


def test_an_ignored_put_keeps_a_schedule(spark):
    """A put replaces a document's schedules, a delete ends them; an ignored put does neither."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    every = '{"tide.on/schedule": {"every": [2, "seconds"], "call": "t"}}'
    rows = [(1, at(0), "put", "a", every, False), (2, at(3), "put", "a", '{"tide.on/schedule": {"every": 1, "call": "u"}}', True),
            (3, at(7), "put", "a", "{}", False), (4, at(1), "put", "b", '{"tide.on/schedule": {"every": 3000}}', None),
            (5, at(5), "delete", "b", None, None), (6, at(8), "put", "c", every, False), (7, at(8), "put", "d", '{"tide.on/schedule": {"every": "soon"}}', None)]
    log = spark.createDataFrame(rows, "tx_id long, tx_time timestamp_ntz, op string, id string, j string, ignore boolean").withColumn(
        "doc", F.try_parse_json("j")).drop("j")
    ticks = Sc.schedule_ticks(log, F.lit(at(10)).cast("timestamp_ntz"))
    zero = 1_704_067_200_000_000
    got = sorted((r["self_id"], r["tx_id"], (r["ts"] - zero) / 1e6) for r in ticks.collect())
    assert got == [("a", 1, 0), ("a", 1, 2), ("a", 1, 4), ("a", 1, 6), ("b", 4, 1), ("b", 4, 4), ("c", 6, 8)]
    fired = Tr.fire_schedule(ticks, Tr.triggers_of(log.filter("not coalesce(ignore, false)")))
    assert fired.count() == 7


def test_globs_meet_only_ids_that_start_as_they_do(spark, monkeypatch):
    ids = spark.createDataFrame([(f"/u/{n}",) for n in range(100, 300)] + [("/v/a.log",)], "id string")
    globs = spark.createDataFrame([(f"/u/{n}?",) for n in range(10, 30)] + [("**.log",), ("/u/{10,11}0",), ("/u/[12]*5",), ("/u/120",)], "glob string")
    for listed in (100, 3):
        monkeypatch.setattr(Tr, "LISTED_STARTS", listed)
        got = sorted(tuple(r) for r in Tr.match_globs(ids, globs).select("id", "glob").collect())
        want = [(f"/u/{n}", f"/u/{n // 10}?") for n in range(100, 300)] + [("/v/a.log", "**.log"), ("/u/100", "/u/{10,11}0"), ("/u/110", "/u/{10,11}0"), ("/u/120", "/u/120")]
        assert got == sorted(want + [(f"/u/{n}", "/u/[12]*5") for n in range(105, 300, 10)])
    monkeypatch.setattr(Tr, "matches_parts", lambda id_, parts: F.lit(True))
    assert Tr.match_globs(ids, globs.filter("glob like '/u/__?'")).count() == 200
    assert "BroadcastExchange" in Tr.match_globs(ids, globs)._jdf.queryExecution().toString()


def test_results_of_standing_queries_are_not_gathered_by_trigger(spark):
    """Few triggers go to the many results that standing queries store."""
    changes = spark.createDataFrame([(3, "/q", 0, "h")], "tx_id long, self_id string, idx int, results_hash string")
    triggers = spark.createDataFrame([("/q", "query", 0, False, None, True, 1, 3), ("/q", "query", 0, False, None, True, 3, None)],
                                     "self_id string, on_k string, idx int, is_vector boolean, glob string, has_call boolean, from_tx long, to_tx long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fired = Tr.fire_query(changes, triggers)
        plan = fired._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [(r["tx_id"], r["self_id"], r["results_hash"]) for r in fired.collect()] == [(3, "/q", "h")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
