"""Mail: message parsing, mailbox splitting, labels, file names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark.functions import text as X
from tidemark.functions.values import let, short_hash

# What a line that starts a message looks like, and what stands in for a body.
FROM_LINE = r"^From \S+.*\d{4}$"
NO_BODY, UNREADABLE, UNSUPPORTED = "<no text body>", "<could not read body>", "<unsupported encoding>"


def is_from_line(line: Column) -> Column:
    return line.rlike(FROM_LINE)


def message_filename(date: Column, subject: Column, message_id: Column) -> Column:
    """``<instant> <hash> <subject>.eml``; the hash keeps equal times and subjects apart."""
    when = F.coalesce(date, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    mid = F.coalesce(message_id, F.concat(F.lit("<no-message-id-"), F.uuid(), F.lit(">")))
    title = X.filename_str(X.ellipsis(F.coalesce(subject, F.lit("<no subject>")), 80))
    return F.concat(X.filename_inst(when), F.lit(" "), short_hash(mid), F.lit(" "), title, F.lit(".eml"))


# -- messages ---------------------------------------------------------------


def header_block(message: Column) -> Column:
    return F.substring_index(X.unix_newlines(message), "\n\n", 1)


def body_text(message: Column) -> Column:
    """What follows the first blank line, newlines normalised."""
    return let(X.unix_newlines(message), lambda m: F.when(
        F.instr(m, "\n\n") > 0, m.substr(F.instr(m, "\n\n") + 2, F.length(m))).otherwise(""))


# Stands for a line fold inside a header while its lines are apart.
_FOLD = "\x01"


def header_lines(message: Column) -> Column:
    """Header lines; a continuation line stays, behind a mark, with the line it continues."""
    return F.split(F.regexp_replace(header_block(message), "\n[ \t]+", _FOLD), "\n")


def folded_header(lines: Column, name: str) -> Column:
    """Value of the last header line with a name (any case) with its folds, null when absent."""
    hits = F.filter(lines, lambda l: F.lower(F.substring_index(l, ":", 1)) == name.lower())
    return F.trim(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), "^[^:]*:", ""))


def header_of(lines: Column, name: str) -> Column:
    return F.replace(folded_header(lines, name), F.lit(_FOLD), F.lit(" "))


def header(message: Column, name: str) -> Column:
    return header_of(header_lines(message), name)


def address(value: Column) -> Column:
    inside = F.regexp_extract(value, r"<([^<>]*)>", 1)
    return F.trim(F.when(inside != "", inside).otherwise(value))


def addresses(value: Column) -> Column:
    """Address parts of an address list; commas in quotes or angle brackets do not separate."""
    found = F.regexp_extract_all(value, F.lit(r'((?:"[^"]*"|<[^>]*>|[^,"<])+)'), F.lit(1))
    return F.filter(F.transform(found, address), lambda a: a != "")


def references(value: Column) -> Column:
    """Lines of a references header, trimmed."""
    lines = F.split(X.strip(F.replace(X.unix_newlines(value), F.lit(_FOLD), F.lit("\n"))), "\n")
    return F.transform(lines, X.strip)


def labels_of(value: Column) -> Column:
    return F.split(value, ",")


def parse_date(value: Column) -> Column:
    """Instant of a Date header, null when it is not one."""
    def read(clean: Column) -> Column:
        return F.coalesce(
            F.try_to_timestamp(clean, F.lit("d MMM yyyy HH:mm:ss xx")),
            F.try_to_timestamp(clean, F.lit("d MMM yyyy HH:mm xx")))

    clean = F.regexp_replace(F.regexp_replace(value, r"\s*\([^)]*\)\s*$", ""), r"^[A-Za-z]{3},\s*", "")
    return let(F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), r"(?:GMT|UTC?|Z)$", "+0000"), read)


def parse_messages(messages: DataFrame, message: str = "text") -> DataFrame:
    """Headers and body of single-part messages as columns, all JVM-side."""
    m = F.col(message)
    # a column of its own, so that the header block is split once per message
    lined = messages.withColumn("__lines", header_lines(m))
    h = lambda name: header_of(F.col("__lines"), name)
    some = lambda a: let(a, lambda x: F.when(F.size(x) > 0, x))
    listed = lambda name: some(addresses(h(name)))
    return lined.select(
        *[c for c in messages.columns if c != message],
        parse_date(h("date")).alias("date"),
        listed("from").alias("from"), listed("to").alias("to"), listed("cc").alias("cc"),
        listed("bcc").alias("bcc"),
        let(h("sender"), address).alias("sender"),
        let(h("subject"), decoded_words).alias("subject"),
        body_text(m).alias("text"),
        h("message-id").alias("message-id"),
        references(folded_header(F.col("__lines"), "references")).alias("references"),
        h("in-reply-to").alias("in-reply-to"),
        h("reply-to").alias("reply-to"),
        h("x-gm-thrid").alias("thread-id"),
        labels_of(h("x-gmail-labels")).alias("labels"))


# An encoded word of a header: charset, encoding, text.
_WORD = r"=\?[^?\s]+\?[BbQq]\?[^?\s]*\?="


def decoded_words(value: Column) -> Column:
    """A header with its encoded words read: base64 or quoted, UTF-8 or Latin-1; others stay as written."""
    together = F.regexp_replace(value, rf"({_WORD})\s+(?={_WORD})", "$1")
    pieces = F.regexp_extract_all(together, F.lit(rf"(?s)({_WORD}|(?:(?!{_WORD}).)+)"), F.lit(1))

    def word(p: Column) -> Column:
        part = lambda n: F.regexp_extract(p, r"^=\?([^?*]+)[^?]*\?([BbQq])\?([^?]*)\?=$", n)
        signs = F.regexp_extract_all(F.replace(part(3), F.lit("_"), F.lit(" ")), F.lit("(?s)(=[0-9A-Fa-f]{2}|.)"), F.lit(1))
        quoted = F.unhex(F.array_join(F.transform(signs, lambda s: F.when(
            F.length(s) == 3, F.substring(s, 2, 2)).otherwise(F.hex(s.cast("binary")))), ""))
        data = F.when(F.lower(part(2)) == "b", F.try_to_binary(part(3), F.lit("base64"))).otherwise(quoted)
        charset = F.lower(part(1))
        text = F.when(charset.isin("utf-8", "utf8", "us-ascii"), F.try_validate_utf8(data.cast("string"))).when(
            charset.isin("iso-8859-1", "latin1"), F.decode(data, "ISO-8859-1"))
        return F.coalesce(text, p)

    read = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{_WORD}$"), word(p)).otherwise(p)), "")
    return F.when(value.contains("=?"), read).otherwise(value)


def is_multipart(message: Column) -> Column:
    kind = F.coalesce(header(message, "content-type"), F.lit("text/plain"))
    encoding = F.lower(F.coalesce(header(message, "content-transfer-encoding"), F.lit("7bit")))
    return ~F.lower(kind).startswith("text/plain") | encoding.isin("base64", "quoted-printable")


def _leaf(part) -> tuple[str, str]:
    kind = str(part.get("Content-Type") or part.get_content_type())
    if part.get_content_maintype() != "text":
        return kind, ""
    try:
        data = part.get_payload(decode=True)
        charset = part.get_content_charset()
        return kind, data.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return kind, UNSUPPORTED
    except Exception:
        return kind, UNREADABLE


def _leaves(part) -> list[tuple[str, str]]:
    """Readable parts, plain text instead of HTML where a part offers both."""
    if not part.is_multipart():
        return [_leaf(part)]
    kids = part.get_payload()
    plain = [p for p in kids if p.get_content_type() == "text/plain"
             and "; name=" not in str(p.get("Content-Type", "")).lower()]
    if plain and any(p.get_content_type() == "text/html" for p in kids):
        kids = plain[:1]
    return [leaf for k in kids for leaf in _leaves(k)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("body", T.StringType())])))
def mime_parts(messages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Content type and decoded text of each part of a MIME message, given as bytes."""
    from email import message_from_bytes

    for batch in messages:
        yield batch.map(lambda m: None if m is None else [
            {"kind": k, "body": b} for k, b in _leaves(message_from_bytes(bytes(m)))])


def parts_text(parts: Column) -> Column:
    """Text of MIME parts: bodies, HTML as text, and a line for each attachment."""
    def one(p: Column) -> Column:
        kind = F.lower(p["kind"])
        attached = F.concat(F.lit("Attachment: "), p["kind"], F.lit("\n"))
        return (
            F.when(kind.contains("; name="), attached)
            .when(kind.startswith("text/plain"), p["body"])
            .when(kind.startswith("text/html"), X.html_text(p["body"]))
            .otherwise(attached)
        )

    return F.coalesce(X.unix_newlines(F.array_join(F.transform(parts, one), "\n")), F.lit(NO_BODY))


def text_of_bytes(data: Column) -> Column:
    """Bytes as UTF-8 text; what is not UTF-8 is replaced."""
    return F.make_valid_utf8(data.cast("string"))


def read_messages(messages: DataFrame, message: str = "text", data: str | None = None) -> DataFrame:
    """Like ``parse_messages``; only messages that need MIME decoding pass through Python.

    ``data`` names a column with the bytes of messages whose text is not all UTF-8 and null for
    the others: each part of these is read in its own charset.
    """
    eight_bit = F.lit(None).cast("binary") if data is None else F.col(data)
    whole = F.coalesce(eight_bit, F.col(message).cast("binary"))
    raw = messages.withColumn("__raw", F.when(eight_bit.isNotNull() | is_multipart(F.col(message)), whole))
    parsed = parse_messages(raw.drop(data) if data else raw, message)
    # one pass: the others go to Python as nulls
    text = F.when(F.col("__raw").isNotNull(), parts_text(mime_parts(F.col("__raw")))).otherwise(F.col("text"))
    return parsed.withColumn("text", text).drop("__raw")


def eml_reader(files: DataFrame) -> DataFrame:
    """Messages as documents; attributes without a value are left out. A column ``raw`` is read as ``read_paths`` gives it."""
    data = [c for c in files.columns if c == "raw"]
    rows = read_messages(files.select("id", "text", *data), data=data[0] if data else None)
    names = [c for c in rows.columns if c != "id"]
    entries = F.array(*[
        F.struct(F.lit(c).alias("key"), F.to_variant_object(F.array(F.col(c))).alias("v")) for c in names])
    present = F.filter(
        entries, lambda e: F.try_variant_get(e["v"], "$[0]", "string").isNotNull()
        | F.try_variant_get(e["v"], "$[0]", "array<string>").isNotNull())
    doc = F.map_from_entries(F.transform(
        present, lambda e: F.struct(e["key"], F.try_variant_get(e["v"], "$[0]", "variant").alias("value"))))
    return rows.select("id", F.to_variant_object(doc).alias("doc"))


# -- mailboxes --------------------------------------------------------------


def mailbox_lines(spark: SparkSession, root: str, pattern: str = "*.mbox") -> DataFrame:
    """``(mailbox, block, pos, line)`` of mailbox files.

    A large file is read in parallel blocks. Within a block rows keep file order,
    which ``monotonically_increasing_id`` on the scan itself records.
    """
    scan = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    return scan.select(
        F.col("_metadata.file_path").alias("mailbox"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace("value", "\r$", "").alias("line"))


def split_mailbox(lines: DataFrame, drop_n: int = 0) -> DataFrame:
    """``(mailbox, n, message)``: the messages of mailboxes given as ordered lines.

    Lines fall into alternating runs of From-lines and other lines; the runs are
    taken in pairs and the second of each pair is a message. So consecutive
    From-lines count once, and text before the first From-line shifts the pairs.

    Runs are numbered in two steps, within blocks and across the blocks of a
    mailbox, so a mailbox of any size is never in one task; a group of the last
    step is one message.
    """
    flagged = lines.withColumn("is_from", is_from_line(F.col("line")))
    key = ["mailbox", "block"]
    inside = W.partitionBy(*key).orderBy("pos")
    across = W.partitionBy("mailbox").orderBy("block")
    before = F.lag("is_from").over(inside)
    marked = flagged.withColumn("turn", (before.isNotNull() & (before != F.col("is_from"))).cast("int"))
    numbered = marked.withColumn(
        "turns", F.sum("turn").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    blocks = numbered.groupBy(*key).agg(
        F.sum("turn").alias("inner_turns"),
        F.min_by("is_from", "pos").alias("head"), F.max_by("is_from", "pos").alias("tail"))
    border = F.lag("tail").over(across)
    blocks = blocks.withColumn("border", (border.isNotNull() & (border != F.col("head"))).cast("int"))
    upto = across.rowsBetween(W.unboundedPreceding, -1)
    # turns before a block: those inside earlier blocks, and every border up to its own
    blocks = blocks.select(
        *key,
        (F.coalesce(F.sum("inner_turns").over(upto), F.lit(0))
         + F.sum("border").over(across.rowsBetween(W.unboundedPreceding, 0))).alias("base"))
    runs = numbered.join(blocks, key).withColumn("run", F.col("turns") + F.col("base"))
    pairs = runs.withColumn("n", F.floor(F.col("run") / 2) + 1)
    body = F.col("run") % 2 == 1
    # an odd last run has no partner: an empty message
    texts = pairs.groupBy("mailbox", "n").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.when(body, F.struct("block", "pos", "line")))),
            lambda l: l["line"]), "\n").alias("message"))
    return texts.filter(F.col("n") > drop_n)


# -- labels -----------------------------------------------------------------


def derive_labels(labels: Column, flags: Column) -> Column:
    """Labels without their leading backslash, plus Opened or Unread, and Archived."""
    bare = F.transform(labels, lambda l: F.regexp_replace(l, r"^\\", ""))
    seen = F.when(flags.contains("\\Seen"), F.lit("Opened")).otherwise(F.lit("Unread"))
    archived = F.when(F.array_contains(bare, "Inbox"), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("Archived")))
    return F.concat(bare, F.array(seen), archived)
