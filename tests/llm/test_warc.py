import base64
import gzip
import hashlib

from tidemark.llm import warc as op
from tidemark.llm.queries import QUERIES

BLOCK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b\r\n\r\n<html lang=fr><title>T \xe9</title><p>caf\xe9"


def fields(block):
    return dict(line.split(": ", 1) for line in block.split("\r\n") if line)


def test_one_response():
    meta, conv = op.derive_one("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", {"WARC-Payload-Digest": "sha1:X", "WARC-IP-Address": "1.2.3.4"}, BLOCK)
    assert (meta[1], conv[1]) == ("metadata", "conversion") and meta[2] == conv[2] == "<urn:uuid:1>" and meta[0] != conv[0]
    f = fields(meta[-1])
    assert f["source-payload-digest"] == "sha1:X" and f["payload-digest-holds"] == "false" and f["source-warc-ip-address"] == "1.2.3.4"
    assert f["status"] == "200" and f["http-x-a"] == "b" and f["title"] == "T é" and f["language"] == "fr" and f["charset"] == "latin-1"
    assert conv[-1] == "café" and conv[6] == 5 and conv[8] == "sha1:X"
    assert conv[7] == "sha1:" + base64.b32encode(hashlib.sha1("café".encode()).digest()).decode()


def test_odd_responses():
    assert [r[1] for r in op.derive_one(None, None, None, None, None)] == ["metadata"]
    assert [r[1] for r in op.derive_one("i", None, None, None, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")] == ["metadata"]
    assert op.derive_one("i", None, None, None, b"HTTP/1.1 404\r\nContent-Type: text/plain\r\n\r\nnone")[1][-1] == "none"
    assert op.derive_one("i", None, None, None, b"<p>no head")[1][-1] == "no head"
    packed = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"packed")
    assert op.derive_one("i", None, None, None, packed)[1][-1] == "packed"
    assert op.derive_one("i", None, None, None, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none-such\r\n\r\nx")[1][-1] == "x"


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é\r\n\r\nWARC/1.1 x", 5), (1, "http://a/", "<p>é\r\n\r\nWARC/1.1 x", 5), (None, None, None, 1)],
                                  "page_id long, url string, html string, block int")
    records = op.derive(op.responses_of(pages)).cache()
    op.write_files(records.coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    got = sorted((h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Block-Digest"], b.decode()) for h, b in op.parse_file(data))
    assert got == sorted((r.record_id, r.refers_to, r.block_digest, r.block) for r in records.collect()) and len(got) == 6
    assert all(op.digest(b) == h["WARC-Block-Digest"] for h, b in op.parse_file(gzip.compress(data)))
    assert op.derive(op.responses_of(pages.limit(0))).count() == 0


def test_read_responses(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nWARC-Target-URI: http://b/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(BLOCK), BLOCK)
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record))
    derived = op.derive(op.read_responses(spark, str(tmp_path))).collect()
    assert {(r.type, r.refers_to, r.target_uri) for r in derived} == {(t, "<urn:uuid:9>", "http://b/") for t in ("metadata", "conversion")}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.url: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op10_warc"][0](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert len(rows) == 2 * n and len({r.record_id for r in rows}) == 2 * n
    for r in rows:
        html = pages[r.target_uri].encode()
        assert r.payload_digest == op.digest(html) or list(pages).count(r.target_uri) > 1
        assert r.block_digest == op.digest(r.block.encode()) and r.content_length == len(r.block.encode())
