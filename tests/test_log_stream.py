"""A log, its manifest and the stream of its firings."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import store as St, triggers as Tr
from tidemark.streaming.firings import start_log_firings
from tidemark.streaming.sync import read_log

ROWS = [(1, 1, "put", "/a", '{"tide.on/modify": "f", "tide.on/tx": "t"}'), (1, 2, "put", "/m/p", '{"tide.on/pattern": {"glob": "/x/*", "call": "p"}}'),
        (1, 3, "put", "/x/1", "{}"), (2, 4, "put", "/x/2", "{}"), (2, 5, "delete", "/a", None), (3, 6, "put", "/a", '{"tide.on/modify": ["g", "h"]}'),
        (3, 7, "put", "/x/3", '{"tide.on/ignore": true}'), (4, 8, "delete", "/m/p", None), (4, 9, "delete", "/x/1", None), (5, 10, "put", "/x/1", "{}")]


def rows_of(spark, txs):
    df = spark.createDataFrame([r for r in ROWS if r[0] in txs], "tx_id long, op_seq long, op string, id string, j string")
    return df.withColumn("doc", F.try_parse_json("j")).drop("j")


def run(spark, tmp_path, **more):
    start_log_firings(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "offsets"), **more).awaitTermination()
    cols = ["tx_id", "rank", "op_seq", "on_k", "self_id", "idx", "on_path", "target_id", "spec"]
    return sorted(map(str, (tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())))


def batch(spark):
    log = rows_of(spark, range(9))
    ops = log.withColumn("ignore", F.col("id") == "/x/3")
    return sorted(str(tuple(r)) for r in Tr.compute_firings(St.normalise_ops(ops), Tr.triggers_of(log)).collect())


@pytest.mark.parametrize("at_once", [None, 1])
def test_micro_batches_equal_one_batch(spark, tmp_path, at_once):
    log = str(tmp_path / "log")
    # a transaction of several files, then two runs of the stream with more transactions in between
    St.append_ops(rows_of(spark, [1]).drop("tx_id").repartition(3), log, 1, F.current_timestamp())
    St.append_ops(rows_of(spark, [2]).drop("tx_id").repartition(2), log, 2, F.current_timestamp())
    run(spark, tmp_path, transactions_at_once=at_once)
    St.append_log(rows_of(spark, [3, 4, 5]).withColumn("tx_time", F.current_timestamp()), log)
    got = run(spark, tmp_path, transactions_at_once=at_once)
    assert got == batch(spark) and {r["tx_id"] for r in read_log(spark, log).collect()} == {1, 2, 3, 4, 5}


def test_a_transaction_appended_again_fires_once(spark, tmp_path):
    log = str(tmp_path / "log")
    St.append_log(rows_of(spark, range(9)).withColumn("tx_time", F.current_timestamp()), log)
    once = run(spark, tmp_path)
    St.append_ops(rows_of(spark, [2]).drop("tx_id"), log, 2, F.current_timestamp())
    assert run(spark, tmp_path) == once == batch(spark)


def test_rows_without_a_manifest_line_wait(spark, tmp_path):
    """A transaction whose files are there only in part is not seen."""
    log = str(tmp_path / "log")
    St.append_ops(rows_of(spark, [1]).drop("tx_id"), log, 1, F.current_timestamp())
    rows_of(spark, [2]).drop("tx_id").write.parquet(f"{log}/tx_id=2")
    assert {r.split(",")[0] for r in run(spark, tmp_path)} == {"(1"}


def test_operations_are_numbered_alike_in_every_attempt(spark, tmp_path):
    log = str(tmp_path / "log")
    seen = []
    for _ in range(2):
        St.append_ops(rows_of(spark, [1]).drop("tx_id", "op_seq").repartition(3), log, 1, F.current_timestamp())
        seen.append({(r["id"], r["op_seq"]) for r in read_log(spark, log).collect()})
    assert seen[0] == seen[1] and len({s for _, s in seen[0]}) == 3
