"""Folders followed through their life: write, merge, rewrite, delete."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import store as St
from tidemark.streaming.sync import read_log, sync_folders


def test_lifecycle(spark, tmp_path):
    root, log = tmp_path / "user", str(tmp_path / "log")
    root.mkdir()
    clock = [1_700_000_000]
    tx = [0]

    def write(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
        clock[0] += 10
        os.utime(root / name, (clock[0], clock[0]))

    def sync(**kw):
        tx[0] += 1
        stale = sync_folders(spark, {"test": str(root)}, log, tx[0], F.lit(tx[0]).cast("timestamp"), **kw)
        ops = {r["id"]: r["op"] for r in stale.collect()}
        docs = {r["id"]: (r["parent"], r["m"], json.loads(r["d"]) if r["d"] else None) for r in St.as_of(
            read_log(spark, log)).select("id", "parent", F.unix_seconds("modified").alias("m"), F.to_json("doc").alias("d")).collect()}
        return ops, docs

    write("file.txt", "")
    ops, docs = sync()
    assert ops == {"/test/file.txt": "put"} and docs == {"/test/file.txt": ("/test", clock[0], None)}
    write("file.txt.meta.edn", '{:foo "bar"}')
    write("notes/a.md", "---\nx: 1\n---\n[[b]]")
    write("notes/b.md", "")
    ops, docs = sync()
    assert set(ops) == {"/test/file.txt", "/test/notes", "/test/notes/a.md", "/test/notes/b.md"}
    assert docs["/test/notes"][::2] == ("/test", None)
    assert docs["/test/file.txt"][2] == {"foo": "bar"}
    assert docs["/test/notes/a.md"][::2] == ("/test/notes", {"x": 1, "tide/refs": ["/test/notes/b.md"]})
    assert sync()[0] == {}
    assert sync(force="/test/notes/*")[0] == {"/test/notes/a.md": "put", "/test/notes/b.md": "put"}
    write("one.json", '{"one": 1, "two": 1}')
    write("one.json.meta.edn", "{:one 2}")
    (root / "file.txt").unlink()
    ops, docs = sync()
    # the sidecar is newer than the content was: nothing changed for file.txt
    assert ops == {"/test/one.json": "put"} and docs["/test/one.json"][2] == {"one": 2, "two": 1}
    (root / "file.txt.meta.edn").unlink()
    ops, docs = sync()
    assert ops == {"/test/file.txt": "delete"} and "/test/file.txt" not in docs
    h = St.history(read_log(spark, log)).filter("id = '/test/file.txt'")
    assert [r["op"] for r in h.orderBy("tx_id").collect()] == ["put", "put", "delete"]


def test_a_log_that_cannot_be_read_is_not_empty(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none")).count() == 0

    class Reader:
        def schema(self, _):
            return self

        def parquet(self, _):
            raise AnalysisException("denied")

    class Session:
        read = Reader()

    with pytest.raises(AnalysisException):
        read_log(Session(), "log")
