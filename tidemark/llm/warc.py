"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response gives a ``metadata`` record, and one whose payload is HTML or plain
text also a ``conversion`` record with the text it shows. Both refer to the response
by WARC-Refers-To and repeat its WARC-Target-URI, WARC-Date and WARC-Payload-Digest;
the metadata block lists what was found (status, content type and charset, title,
language, the response's own digests and whether they hold) and repeats the HTTP
headers, each with the prefix ``http-``. Record ids are made from type and response
id, so a task that runs again writes the same records.

A digest that the response carries is kept as it is; a missing one is computed. A
block without an HTTP head is payload as a whole. Null blocks are empty; a response
without an id is named after its content; without a date or address the header is
left out. Rows that repeat give records that repeat, with equal ids.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.html_text import SPACE, title_of, to_text

VERSION = "WARC/1.1"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RESPONSE = "record_id string, target_uri string, date string, headers map<string,string>, block binary"
DERIVED = ("record_id string, type string, refers_to string, target_uri string, date string, content_type string, "
           "content_length bigint, block_digest string, payload_digest string, block string")


def digest(data: bytes) -> str:
    """A labelled digest as WARC headers carry it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, kind + ' ' + source)}>"


def http_parts(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    m = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[:m.start()], block[m.end():]) if m else (block, b"")
    first, *lines = head.decode("latin-1").splitlines()
    status = re.match(r"HTTP/\S+ (\d{3})", first)
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip().lower(), value.strip()))
    if dict(headers).get("content-encoding", "").lower() in ("gzip", "x-gzip"):
        try:
            payload = gzip.decompress(payload)
        except (OSError, EOFError):
            pass
    return int(status[1]) if status else None, headers, payload


def decoded(payload: bytes, content_type: str) -> tuple[str, str]:
    """Text and charset: as the header says, else as the page says, else UTF-8."""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I) or re.search(
        r"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", payload[:2048].decode("latin-1"), re.I)
    charset = m[1].lower() if m else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def one_line(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def derive_one(source: str | None, uri: str | None, date: str | None, headers: dict[str, str] | None, block: bytes | None) -> list[tuple]:
    """The records derived from one response."""
    block = bytes(block or b"")
    known = {k.lower(): v for k, v in (headers or {}).items() if v is not None}
    status, http, payload = http_parts(block)
    content_type = dict(http).get("content-type", "text/html" if status is None and payload.lstrip()[:1] == b"<" else "")
    # a digest is of the payload as it was sent
    sent = block[len(block) - len(block.split(b"\r\n\r\n", 1)[-1]):] if status is not None and b"\r\n\r\n" in block else payload
    block_digest, payload_digest = digest(block), digest(sent)
    source = source or record_id("response", f"{uri} {block_digest}")
    kept_payload = known.get("warc-payload-digest", payload_digest)
    fields = [("refers-to", source), ("source-block-digest", known.get("warc-block-digest", block_digest)),
              ("source-payload-digest", kept_payload)]
    for name, own in (("block", block_digest), ("payload", payload_digest)):
        if f"warc-{name}-digest" in known:
            fields.append((f"{name}-digest-holds", str(known[f"warc-{name}-digest"] == own).lower()))
    fields += [("source-" + k, one_line(v)) for k, v in sorted(known.items()) if k not in ("warc-block-digest", "warc-payload-digest")]
    if status is not None:
        fields.append(("status", str(status)))
    kind = content_type.split(";")[0].strip().lower()
    text = None
    if kind in ("text/html", "application/xhtml+xml", "text/plain"):
        page, charset = decoded(payload, content_type)
        fields += [("content-type", kind), ("charset", charset)]
        if kind == "text/plain":
            text = page
        else:
            text, title = to_text(page), title_of(page)
            lang = re.search(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", page, re.I)
            fields += [("title", title)] if title else []
            fields += [("language", lang[1])] if lang else []
    fields += [("http-" + k, one_line(v)) for k, v in http]
    out = []
    for name, type_, body in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
                              ("conversion", "text/plain; charset=utf-8", text)):
        if body is not None:
            data = body.encode("utf-8", "replace")
            out.append((record_id(name, source), name, source, uri, date, type_, len(data), digest(data), kept_payload, data.decode()))
    return out


def derive(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of a table of responses with the columns of ``RESPONSE``."""
    bounded_batches(responses.sparkSession)
    names = [c.split()[0] for c in RESPONSE.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in DERIVED.split(", ")]
        for batch in batches:
            rows = []
            for source, uri, date, headers, block in zip(*(batch[c] for c in names)):
                rows += derive_one(source, uri, date, dict(headers) if headers is not None else None, block)
            yield pd.DataFrame(rows, columns=columns)

    return responses.select(*names).mapInPandas(build, DERIVED)


def responses_of(pages: DataFrame, url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z",
                 key: str | None = None) -> DataFrame:
    """Response records of a table of pages, as a crawler would have written them; ``date`` is when it ran."""
    text = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(text).cast("string"), F.lit("\r\n\r\n"))
    named = F.md5(F.concat_ws("\n", *([F.col(key).cast("string")] if key else []), F.coalesce(F.col(url), F.lit("")), text).cast("binary"))
    part = lambda a, n: F.substring(named, a, n)
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")).alias("record_id"),
        F.col(url).alias("target_uri"), F.lit(date).alias("date"),
        F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("Content-Type"), F.lit("application/http; msgtype=response")).alias("headers"),
        F.concat(head, text).cast("binary").alias("block"))


def record_text() -> Column:
    """A derived record as it stands in a file, without the two line ends after it."""
    header = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), c, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit(VERSION + "\r\n"), header("WARC-Type", F.col("type")), header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Refers-To", F.col("refers_to")), header("WARC-Target-URI", F.col("target_uri")), header("WARC-Date", F.col("date")),
        header("WARC-Block-Digest", F.col("block_digest")), header("WARC-Payload-Digest", F.col("payload_digest")),
        header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"), F.col("block"))


def write_files(records: DataFrame, path: str) -> None:
    """WARC files, one for each partition, by Spark's own writer: a failed task leaves nothing behind."""
    records.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse_file(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; a gzip file may have a member per record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip()] = value.strip()
        size = next((int(v) for k, v in headers.items() if k.lower() == "content-length" and v.isdigit()), 0)
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files; a file is read by one task, so files should be of usual size, about 1 GB."""
    names = [c.split()[0] for c in RESPONSE.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for headers, block in parse_file(bytes(content)):
                    own = {k.lower(): v for k, v in headers.items()}
                    if own.get("warc-type") == "response":
                        rows.append((own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), headers, block))
                        size += len(block)
                    if size > 1 << 23:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RESPONSE)
