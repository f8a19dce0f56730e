import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import edn, feeds, files as Fs, html as H, mail as Ml, markdown as Md, readers as R, sinks
from tidemark.streaming.firings import start_firings

NOTE = """---
tags:
  - accepted
  - done
text: one two three
checkbox: true
number: 14
date: 1986-04-25
datetime: 1986-04-25T16:00:00
text-link: "[[another file]]"
tide/k: '{:foo "bar"}'
tide.a/ks:
  - "n.s/sym"
  - "{:call n.s/other}"
  - '[:sh "echo"]'
---
body #learning [[other file]] [a md link](./md%20link.md) [[inbox/another file]] [[another file#^b8|x]] [[gone]]
"""


def test_edn_parse():
    p = edn.parse
    assert p('{:a 1 :b/c [1.5 nil true "x\\n" \\a] ; note\n :s #{"b" "a"} :f (fn [x] x) #_skip}') == {
        "a": 1, "b/c": [1.5, None, True, "x\n", "a"], "s": ["a", "b"], "f": "(fn [x] x)"}
    assert p('#inst "2024-01-01"') == "2024-01-01" and p(":k") == ":k" and p("n.s/x") == "n.s/x"
    for bad in ("", "{:a", "[1}", "{:a}", ")"):
        assert edn.to_json(bad) is None


def test_readers_by_extension(spark):
    a, b = (lambda df: df), (lambda df: df)
    rs = R.resolve_readers
    assert rs("md", {}) == []
    assert rs("md", {}, {"readers": {"md": a}}) == [a]
    assert rs("md", {}, {"readers": {"md": [a, b]}}) == [a, b]
    assert rs("md", {}, {"readers": {"md": a}}, {"readers": {"md": b}}) == [b]
    assert rs("md", {}, {"readers": {"md": a}}, {"extra_readers": {"md": b}}) == [a, b]
    assert rs("md", {}, None, {"extra_readers": {"md": a}}) == [a]


def test_mounted_folder(spark, tmp_path):
    root = tmp_path / "user"
    (root / ".git").mkdir(parents=True)
    (root / "inbox").mkdir()
    for name, text in {
        "note.md": NOTE, "another file.md": "", "other file.md": "", "md link.md": "", "inbox/another file.md": "",
        "one.edn": "{:one 1}", "one.edn.meta.edn": "{:one 2 :two {:x 1}}", "bad.json": "{", "list.json": "[1]",
        "ok.json": '{"a": {"b": 1}}', "only.txt.meta.edn": "{:foo \"bar\"}", "empty.txt": "", ".git/x.json": "{}",
    }.items():
        (root / name).write_text(text)
    listing = Fs.mount_files(spark, {"vault": str(root)})
    ids = {r["id"] for r in listing.collect()}
    assert "/vault/only.txt" in ids and "/vault/.git/x.json" not in ids and "/vault/inbox/another file.md" in ids
    text = Fs.mount_files(spark, {"vault": str(root)}, text=True)
    content = R.read_documents(text.filter("not is_sidecar"))
    refs = Md.ref_pairs(Md.markdown_refs(text.filter("id like '%.md'"), listing.filter("not is_sidecar")))
    content = content.unionByName(refs)
    sidecars = edn.edn_reader(text.filter("is_sidecar").select("id", "text"))
    docs = {r["id"]: (r["parent"], json.loads(r["d"]) if r["d"] else None) for r in R.assemble(
        Fs.latest_modified(listing), R.merge_documents(content.withColumn("prio", F.lit(0))), sidecars).select(
        "id", "parent", F.to_json("doc").alias("d")).collect()}
    assert docs["/vault/one.edn"] == ("/vault", {"one": 2, "two": {"x": 1}})
    assert docs["/vault/only.txt"][1] == {"foo": "bar"}
    assert docs["/vault/bad.json"][1] is None and docs["/vault/list.json"][1] is None and docs["/vault/empty.txt"][1] is None
    assert docs["/vault/ok.json"][1] == {"a": {"b": 1}}
    note = docs["/vault/note.md"][1]
    assert note["tags"] == ["accepted", "done"] and note["checkbox"] is True and note["number"] == 14
    assert note["date"] == "1986-04-25T00:00:00Z" and note["datetime"] == "1986-04-25T16:00:00Z"
    assert note["tide/k"] == {"foo": "bar"}
    assert note["tide.a/ks"] == ["n.s/sym", {"call": "n.s/other"}, [":sh", "echo"]]
    assert note["tide/refs"] == ["/vault/another file.md", "/vault/inbox/another file.md", "/vault/md link.md", "/vault/other file.md"]
    folders = {r["id"] for r in Fs.folder_docs(listing.select("id")).collect()}
    assert folders == {"/vault", "/vault/inbox"}


MAIL = ("From: \"Author, A\" <author@example.com>\nTo: Recipient <r@example.com>,\n other@example.com\nMessage-ID: 123\n"
        "References: <a@x>\n <b@x>\nSubject: old\nSubject: Sample message 1\nDate: Fri, 8 Jul 2011 12:08:34 +0200 (CEST)\n"
        "X-Gmail-Labels: Inbox,Opened\n\nThis is the body.\nThere are 2 lines.\n")
ALTERNATIVE = ("Subject: m\nContent-Type: multipart/mixed; boundary=A\n\n--A\nContent-Type: multipart/alternative; boundary=B\n\n"
               "--B\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nh=C3=A9llo\n"
               "--B\nContent-Type: text/html\n\n<p>no</p>\n--B--\n--A\nContent-Type: image/png; name=x.png\n\nzzz\n--A--\n")


@pytest.mark.parametrize("crlf", [False, True])
def test_messages(spark, crlf):
    raw = MAIL.replace("\n", "\r\n") if crlf else MAIL
    r = Ml.read_messages(spark.createDataFrame([(1, raw)], "n int, text string")).first()
    assert r["from"] == ["author@example.com"] and r["to"] == ["r@example.com", "other@example.com"]
    assert r["message-id"] == "123" and r["subject"] == "Sample message 1" and r["cc"] is None
    assert r["references"] == ["<a@x>", "<b@x>"] and r["labels"] == ["Inbox", "Opened"]
    assert r["text"] == "This is the body.\nThere are 2 lines.\n"
    assert r["date"].astimezone(dt.timezone.utc).isoformat() == "2011-07-08T10:08:34+00:00"


def test_multipart(spark):
    html = "Subject: h\nContent-Type: text/html\n\n<p>a<br>b</p><style>x</style>\n"
    rows = Ml.read_messages(spark.createDataFrame([(1, ALTERNATIVE), (2, html), (3, "Subject: s\n\nplain")], "n int, text string"))
    got = {r["n"]: r["text"] for r in rows.collect()}
    assert got[1].strip() == "héllo\nAttachment: image/png; name=x.png"
    assert got[2].split() == ["a", "b"] and got[3] == "plain"


def test_mail_is_read_in_the_charsets_of_its_parts(spark):
    plain = "Subject: s\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\nGrüße\n".encode("latin-1")
    parts = b"\n".join([
        b"Subject: t\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=cut\n",
        b"--cut\nContent-Type: text/plain; charset=windows-1252\nContent-Transfer-Encoding: 8bit\n", "„zehn €“".encode("cp1252"),
        b"--cut\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n", "naïve".encode(),
        b"--cut\nContent-Type: text/plain; charset=none-such\nContent-Transfer-Encoding: 8bit\n", b"\xff", b"--cut--\n"])
    rows = [(1, bytearray(plain)), (2, bytearray(parts)), (3, bytearray(b"Subject: u\n\nascii")), (4, None), (5, bytearray(b""))]
    df = spark.createDataFrame(rows, "n int, raw binary").withColumn("text", Ml.text_of_bytes(F.col("raw")))
    got = {r["n"]: (r["subject"], r["text"]) for r in Ml.read_messages(df, data="raw").collect()}
    assert got[1] == ("s", "Grüße\n") and got[3] == ("u", "ascii")
    assert got[2] == ("t", f"„zehn €“\nnaïve\n{Ml.UNSUPPORTED}")
    assert got[4][0] is None and got[5][0] is None
    # without the bytes only what is UTF-8 can be read
    lossy = {r["n"]: r["text"] for r in Ml.read_messages(df.drop("raw")).collect()}
    assert lossy[1] == "Gr\ufffd\ufffde\n" and lossy[3] == "ascii"


def test_files_that_are_not_utf8_keep_their_bytes(spark, tmp_path):
    latin = "Subject: s\nContent-Type: text/plain; charset=iso-8859-1\n\nGrüße".encode("latin-1")
    (tmp_path / "a.eml").write_bytes(latin)
    (tmp_path / "b.eml").write_bytes("Subject: t\n\nGrüße".encode())
    (tmp_path / "c.eml").write_bytes(b"")
    listed = spark.createDataFrame([(f"/m/{n}", str(tmp_path / n)) for n in ("a.eml", "b.eml", "c.eml", "gone.eml")], "id string, path string")
    files = Fs.read_paths(listed)
    read = {r["id"]: (r["text"], r["raw"]) for r in files.collect()}
    assert read["/m/a.eml"][1] == latin and "\ufffd" in read["/m/a.eml"][0]
    assert read["/m/b.eml"] == ("Subject: t\n\nGrüße", None) and read["/m/c.eml"] == ("", None) and read["/m/gone.eml"] == (None, None)
    docs = {r[0]: json.loads(r[1]) for r in Ml.eml_reader(files).select("id", F.to_json("doc")).collect()}
    assert docs["/m/a.eml"]["text"] == docs["/m/b.eml"]["text"] == "Grüße"


def test_eml_documents(spark):
    doc = Ml.eml_reader(spark.createDataFrame([("/m/a.eml", MAIL)], "id string, text string")).select(F.to_json("doc")).first()[0]
    doc = json.loads(doc)
    assert doc["subject"] == "Sample message 1" and doc["to"] == ["r@example.com", "other@example.com"]
    assert "cc" not in doc and "sender" not in doc


def reference_split(lines):
    runs = []
    for l in lines:
        f = bool(__import__("re").match(r"^From \S+.*\d{4}$", l))
        if runs and runs[-1][0] == f:
            runs[-1][1].append(l)
        else:
            runs.append((f, [l]))
    pairs = [runs[i:i + 2] for i in range(0, len(runs), 2)]
    return ["\n".join(p[1][1]) if len(p) > 1 else "" for p in pairs]


HEAD = "From archive@example.com Mon Feb  5 09:30:00 2024"


@pytest.mark.parametrize("text", [
    f"{HEAD}\nSubject: a\n\nFrom here on\nx\n\n{HEAD}\nSubject: b\n\ny", f"stray\n{HEAD}\nSubject: a\n\nx\n{HEAD}\nSubject: b",
    f"{HEAD}\n{HEAD}\nSubject: a\n\nx", f"{HEAD}\nSubject: a\n\nx\n{HEAD}", "no messages",
])
@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_mailbox_split_over_blocks(spark, text, block):
    lines = text.split("\n")
    df = spark.createDataFrame([("m", i // block, i, l) for i, l in enumerate(lines)], "mailbox string, block int, pos int, line string")
    got = [r["message"] for r in Ml.split_mailbox(df).orderBy("n").collect()]
    assert got == reference_split(lines)
    assert Ml.split_mailbox(df, drop_n=1).count() == max(len(got) - 1, 0)


def test_mailbox_files(spark, tmp_path):
    part = "From: A <a@example.com>\r\nMessage-ID: {}\r\nSubject: Sample message {}\r\n\r\nBody.\r\n"
    box = "".join(f"{HEAD}\r\n{part.format(i, n)}\r\n" for i, n in ((123, 1), (456, 2)))
    (tmp_path / "sample.mbox").write_text(box, newline="")
    msgs = Ml.parse_messages(Ml.split_mailbox(Ml.mailbox_lines(spark, str(tmp_path))).withColumnRenamed("message", "text"))
    names = {r[0] for r in msgs.select(Ml.message_filename(F.lit(None).cast("timestamp_ntz"), F.col("subject"), F.col("message-id"))).collect()}
    assert names == {"1970-01-01T00.00.00Z 8d247ee6 Sample message 1.eml", "1970-01-01T00.00.00Z c2dfc80c Sample message 2.eml"}
    # tiny splits: one mailbox read as many blocks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        again = Ml.split_mailbox(Ml.mailbox_lines(spark, str(tmp_path))).select("n", "message").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(again) == 2 and all("Body." in r["message"] for r in again)


def test_labels(value):
    derive = lambda ls, fl: value(lambda f: Ml.derive_labels(F.array(*[F.lit(x) for x in ls]), f), f=fl)
    assert derive(["\\Inbox", "Work"], "\\Seen") == ["Inbox", "Work", "Opened"]
    assert derive(["Work"], "") == ["Work", "Unread", "Archived"]


def test_html(spark):
    page = "<div class='item a'><a id=x>One <b>two</b></a></div><a>three</a><br><div class=item><p><a>four</a></p></div>"
    df = spark.createDataFrame([(1, page)], "k int, html string")
    assert [(r["pos"], r["node_id"], r["text"]) for r in H.select_nodes(df, "div.item a").collect()] == [(0, "x", "One two"), (1, None, "four")]
    assert H.select_nodes(df, "a").count() == 3 and H.select_nodes(df, ".a").count() == 1


def test_markup_of_nodes_is_as_written(spark):
    page = "<p>x</p>\n<article><h1>a &amp; b&am</h1>\n<p><i>c</i><br>d &lt<h1>e"
    df = spark.createDataFrame([(1, page), (2, None)], "k int, html string")
    assert [r["markup"] for r in H.select_nodes(df, "article h1").collect()] == ["a &amp; b&am", "e"]
    assert [r["markup"] for r in H.select_nodes(df, "article p").collect()] == ["<i>c</i><br>d &lt<h1>e"]


def test_files_of_a_table_in_parts_are_one(spark, tmp_path):
    from tidemark.plans import formats

    for t in formats._SCANNED:
        df = spark.range(0 if t == "region" else 6)
        if t == "pages":
            df.selectExpr("id", "id % 3 as k").write.partitionBy("k").parquet(str(tmp_path / f"{t}.parquet"))
        else:
            df.repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = sorted(tuple(r) for r in formats.file_scan(spark, str(tmp_path)).collect())
    assert got == sorted((t, "parquet", 0 if t == "region" else 6, True) for t in formats._SCANNED)


def test_pull_and_cursor(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "uid int, received int")
    got = feeds.incremental_pull(df, "uid", 3, take_n=2)
    assert [r["uid"] for r in got.collect()] == [4, 5] and feeds.next_cursor(got, "uid", 3) == feeds.Cursor(5)
    assert feeds.next_cursor(df.filter("false"), "uid", 3) == feeds.Cursor(3)
    assert feeds.start_cursor(df, "uid", "received", 45) == 4
    assert [r["uid"] for r in feeds.incremental_pull(df, "uid", 3, 2, descending=True).collect()] == [9, 8]


def test_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,name\n1,"a ""b"", c"\n2,d\n')
    docs = {r["id"]: json.loads(r["d"]) for r in Fs.csv_docs(spark, str(tmp_path / "f.csv"), "id").select("id", F.to_json("doc").alias("d")).collect()}
    assert docs == {"1": {"id": "1", "name": 'a "b", c'}, "2": {"id": "2", "name": "d"}}


def test_sinks(spark, tmp_path):
    saved = sinks.SavedQueries(str(tmp_path / "saved"))
    saved.register("ok", lambda s: s.range(3))
    saved.register("bad", lambda s: s.sql("select * from no_such_table"))
    assert spark.read.parquet(saved.run(spark, "ok")).count() == 3
    assert "no_such_table" in spark.read.parquet(saved.run(spark, "bad")).first()["error"]
    folder = str(tmp_path / "result")
    assert [sinks.write_if_changed(spark.range(n), folder) for n in (3, 3, 4)] == [True, False, True]
    rows = spark.createDataFrame([("a.md", "Zinc", 2.0), ("a.md", "Fat", 1.5)], "doc string, k string, v double")
    sinks.write_markdown(sinks.markdown_lines(rows, F.col("doc"), F.col("k"), F.col("v")), str(tmp_path / "md"))
    parts = sorted((tmp_path / "md" / "doc=a.md").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "---\nFat: 1.5\nZinc: 2.0\n---\n"


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    from tidemark.operators.triggers import compute_firings

    trig = spark.createDataFrame([("/a", "modify", 0, False, None), ("/p", "pattern", 0, False, "/*"), ("/t", "tx", 0, False, None)],
                                 "self_id string, on_k string, idx int, is_vector boolean, glob string")
    schema = "tx_id long, op_seq long, op string, id string"
    log, out, ckpt = (str(tmp_path / x) for x in ("log", "out", "ckpt"))
    rows = [(1, 1, "put", "/a"), (1, 2, "delete", "/b"), (2, 3, "put", "/a"), (3, 4, "put", "/c")]
    seen = []
    for tx in (1, 2, 3):
        spark.createDataFrame([r for r in rows if r[0] == tx], schema).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).parquet(log)
        q = start_firings(stream, lambda s: trig, out, ckpt, sink=lambda df, n: seen.append((n, df.count())))
        q.awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    want = compute_firings(spark.createDataFrame(rows, schema), trig)
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*want.columns).collect())
    assert key(got) == key(want) and len(seen) == 3


def test_descending_pulls_lose_nothing(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "uid int")
    at, seen = feeds.Cursor(-1), []
    for _ in range(5):
        got = feeds.incremental_pull(df, "uid", at, 3, descending=True)
        seen += [r["uid"] for r in got.collect()]
        at = feeds.next_cursor(got, "uid", at, 3, descending=True)
    assert seen == list(range(9, -1, -1)) and at == feeds.Cursor(9)
    more = spark.createDataFrame([(i,) for i in range(13)], "uid int")
    assert [r["uid"] for r in feeds.incremental_pull(more, "uid", at, 3, descending=True).collect()] == [12, 11, 10]


def test_a_missing_mount_fails(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)no such file|not exist"):
        Fs.walk_files(spark, str(tmp_path / "gone"))


def test_empty_files_are_documents_read_or_not(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c").write_text("y")
    for text in (False, True):
        got = Fs.mount_files(spark, {"m": str(tmp_path)}, text=text)
        assert sorted(r["id"] for r in got.collect()) == ["/m/a.txt", "/m/b.txt"]


@pytest.mark.parametrize("text, want", [
    ('#:app{:a 1 :b/c 2 :_/d 3}', {"app/a": 1, "b/c": 2, "d": 3}), (r'"caf\u00e9 \n"', "café \n"), (r"[\u0041 \b \newline]", ["A", "b", "\n"]),
    ("{:x ##NaN :y ##-Inf}", {"x": "##NaN", "y": "##-Inf"}), ('[#"a\\d" 1/2]', ['#"a\\d"', "1/2"]), ("#inst \"2024\"", "2024")])
def test_edn_forms(text, want):
    assert edn.parse(text) == want


@pytest.mark.parametrize("raw, want", [
    ("=?UTF-8?B?SMOpbGxv?=", "Héllo"), ("Re: =?utf-8?Q?caf=C3=A9_x?= y", "Re: café x y"), ("=?iso-8859-1?q?caf=E9?=", "café"),
    ("=?UTF-8?B?SMOp?= =?UTF-8?B?bGxv?=", "Héllo"), ("a =? b", "a =? b"), ("=?x-none?B?QQ==?=", "=?x-none?B?QQ==?="), ("=?UTF-8?B?/w==?=", "=?UTF-8?B?/w==?=")])
def test_encoded_words(value, raw, want):
    assert value(Ml.decoded_words, s=raw) == want
