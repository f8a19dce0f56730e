"""Mail: mailboxes, messages, labels and file names."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.plans import inputs as I
from tidemark.plans.registry import register
from tidemark.sources import mail as Ml

QUERIES: dict = {}
query = functools.partial(register, QUERIES)

_MESSAGE_LINES = r"""'From: ' || role || ' <' || role || '@example.com>' || chr(10) || 'To: ' || recipient || chr(10) ||
    'Message-ID: ' || conv_id || '-' || turn || chr(10) ||
    CASE WHEN date IS NOT NULL THEN 'Date: ' || strftime(date, '%-d %b %Y %H:%M:%S') || ' +0000' || chr(10) ELSE '' END ||
    'Subject: ' || subject || chr(10) || chr(10) || body"""


def _mailboxes(spark, sf):
    """One mailbox per conversation, as ordered lines; a block is one turn of it."""
    raw = F.regexp_replace("text", "\r\n", "\n")
    m = I.messages(spark, sf).select(
        "conv_id", "turn", F.split(F.concat(F.lit(I.FROM_HEAD + "\n"), raw), "\n").alias("lines"))
    return m.select(F.col("conv_id").alias("mailbox"), F.col("turn").alias("block"),
                    F.posexplode("lines").alias("pos", "line"))


@query(rf"""WITH {I.MSG}, lines AS (
  SELECT conv_id, turn, unnest(string_split('{I.FROM_HEAD}' || chr(10) || {_MESSAGE_LINES}, chr(10))) AS line,
    generate_subscripts(string_split('{I.FROM_HEAD}' || chr(10) || {_MESSAGE_LINES}, chr(10)), 1) AS pos FROM msg),
flagged AS (SELECT *, regexp_matches(line, '^From [^ \t\n\r]+.*\d{{4}}$') AS f FROM lines),
turned AS (SELECT *, CASE WHEN lag(f) OVER w <> f THEN 1 ELSE 0 END AS t FROM flagged WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)),
runs AS (SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS run FROM turned)
SELECT conv_id AS mailbox, CAST(run // 2 + 1 AS BIGINT) AS n, string_agg(line, chr(10) ORDER BY turn, pos) AS message
FROM runs WHERE run % 2 = 1 GROUP BY 1, 2""")
def mbox_split(spark, sf):
    return Ml.split_mailbox(_mailboxes(spark, sf))


@query(rf"""WITH {I.MSG} SELECT conv_id, turn, role || '@example.com' AS sender, recipient, subject,
  conv_id || '-' || turn AS message_id, {I.sql_ts('date')} AS date, body AS text FROM msg""")
def eml_parse(spark, sf):
    parsed = Ml.parse_messages(I.messages(spark, sf, encoded=True))
    return parsed.select(
        "conv_id", "turn", F.array_join("from", ",").alias("sender"), F.array_join("to", ",").alias("recipient"),
        "subject", F.col("message-id").alias("message_id"),
        F.date_format(F.to_utc_timestamp("date", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"),
        "text")


# 32-bit multiplications of the hash in the oracle, on 128-bit integers
def _mul(a: str, k: int) -> str:
    return f"(({a}) * {k}::HUGEINT) & 4294967295"


def _rotl(a: str, n: int) -> str:
    return f"((({a}) * {1 << n}::HUGEINT) & 4294967295) + (({a}) // {1 << (32 - n)})"


@query(rf"""WITH {I.MSG}, a AS (SELECT *, list_reduce(list_prepend(0::HUGEINT,
    list_transform(string_split(conv_id || '-' || turn, ''), lambda x: unicode(x)::HUGEINT)), lambda h, u: (h * 31 + u) & 4294967295) AS h0 FROM msg),
b AS (SELECT *, {_mul('h0', 0xCC9E2D51)} AS k1 FROM a),
c AS (SELECT *, {_rotl('k1', 15)} AS k2 FROM b),
d AS (SELECT *, {_mul('k2', 0x1B873593)} AS k3 FROM c),
e AS (SELECT *, {_rotl('k3', 13)} AS h1 FROM d),
f AS (SELECT *, xor((h1 * 5 + 3864292196) & 4294967295, 4::HUGEINT) AS h2 FROM e),
g AS (SELECT *, {_mul('xor(h2, h2 // 65536)', 0x85EBCA6B)} AS h3 FROM f),
i AS (SELECT *, {_mul('xor(h3, h3 // 8192)', 0xC2B2AE35)} AS h4 FROM g),
j AS (SELECT *, xor(h4, h4 // 65536) AS h5 FROM i)
SELECT conv_id, turn,
  replace(strftime(coalesce(date, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S'), ':', '.') || 'Z ' ||
  lpad(lower(to_hex(h5::BIGINT)), 8, '0') || ' ' ||
  trim(regexp_replace(CASE WHEN length(subject) > 80 THEN substring(subject, 1, 77) || '...' ELSE subject END,
    '[\\/:*?"<>|]', ' ', 'g')) || '.eml' AS name FROM j""")
def message_filename(spark, sf):
    m = Ml.parse_messages(I.messages(spark, sf, encoded=True))
    date = F.to_utc_timestamp("date", F.current_timezone()).cast("timestamp_ntz")
    name = Ml.message_filename(date, F.col("subject"), F.col("message-id"))
    return m.select("conv_id", "turn", name.alias("name"))


@query(f"""WITH {I.TX} SELECT tx_id, array_to_string(list_filter([type, CASE WHEN value > 20 THEN 'Inbox' END,
  CASE WHEN k > 50 THEN 'Opened' ELSE 'Unread' END, CASE WHEN value > 20 THEN NULL ELSE 'Archived' END], lambda x: x IS NOT NULL), ',') AS labels FROM tx""")
def label_derive(spark, sf):
    t = I.tx(spark, sf)
    kind = F.concat(F.lit("\\"), F.col("type"))
    labels = F.when(F.col("value") > 20, F.array(kind, F.lit("\\Inbox"))).otherwise(F.array(kind))
    flags = F.when(F.col("k") > 50, "\\Seen \\Recent").otherwise("\\Recent")
    return t.select("tx_id", F.array_join(Ml.derive_labels(labels, flags), ",").alias("labels"))


@query("""SELECT page_id, 'plain body of ' || page_id || chr(10) AS text, 'Page ' || page_id AS subject FROM pages""")
def mime_text(spark, sf):
    """Pages sent as mail with a plain and an HTML alternative; the plain one is the text."""
    p = I.spread(I.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    key = F.col("page_id").cast("string")
    raw = F.concat(
        F.lit("Subject: Page "), key, F.lit("\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=cut\n\n"
              "--cut\nContent-Type: text/plain; charset=utf-8\n\nplain body of "), key,
        F.lit("\n\n--cut\nContent-Type: text/html; charset=utf-8\n\n"), F.col("html"), F.lit("\n--cut--\n"))
    return Ml.read_messages(p.select("page_id", raw.alias("text"))).select("page_id", "text", "subject")


@query(r"""SELECT page_id, 'Page ' || page_id AS subject, 'Grüße von Seite ' || page_id || chr(10) ||
  replace(regexp_replace(coalesce(html, ''), '[^\x{0}-\x{FF}]', '?', 'g'), chr(13) || chr(10), chr(10)) AS text FROM pages""")
def mail_charset(spark, sf):
    """Pages sent as 8-bit Latin-1 mail, source and all; what Latin-1 has no sign for is a question mark."""
    p = I.spread(I.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    key = F.col("page_id").cast("string")
    head = F.concat(F.lit("Subject: Page "), key, F.lit(
        "\nMIME-Version: 1.0\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\n"))
    body = F.concat(F.lit("Grüße von Seite "), key, F.lit("\n"), F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x{0}-\x{FF}]", "?"))
    sent = p.select("page_id", F.concat(F.encode(head, "ISO-8859-1"), F.encode(body, "ISO-8859-1")).alias("raw"))
    read = Ml.read_messages(sent.withColumn("text", Ml.text_of_bytes(F.col("raw"))), data="raw")
    return read.select("page_id", "subject", "text")
