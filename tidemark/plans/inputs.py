"""Documents, logs, graphs, triggers and messages derived from the given tables.

Every input comes twice: as a DataFrame and as the SQL of a common table
expression of the same name, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


EPOCH = "2024-01-01 00:00:00"
HALF = "2024-01-15 00:00:00"
UNTIL = "2024-01-31 00:00:00"
FROM_HEAD = "From archive@example.com Mon Feb  5 09:30:00 2024"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a table stored in fewer splits than there are cores.

    For work that is heavy per row. A table of many splits, which is any large
    one, is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, *keys) if splits < cores else df


def ts_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def minutes_after(minutes: Column) -> Column:
    return ntz(EPOCH) + F.make_dt_interval(mins=minutes)


# -- documents --------------------------------------------------------------


def doc_key() -> Column:
    return F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                    F.lit("."), F.col("lang"))


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", *more)
    return d.withColumn("id", doc_key()).withColumn("parent", F.concat(F.lit("/docs/"), F.col("source")))


def docs(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return documents(spark, sf, *more).join(table(spark, sf, "labels"), "doc_id", "left")


DOCS = """docs AS (
  SELECT '/docs/' || source || '/' || d.doc_id || '.' || lang AS id, '/docs/' || source AS parent,
         d.doc_id, lang, source, n_chars, text, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# -- transaction log --------------------------------------------------------


def tx(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("tx_id"),
        F.col("ts").alias("tx_time"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_type").alias("type"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


TX = """tx AS (
  SELECT event_id AS tx_id, ts AS tx_time, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
         '/users/' || user_id AS id, event_type AS type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


# -- references -------------------------------------------------------------


def refs(spark: SparkSession, sf: str) -> DataFrame:
    """A graph on all documents: chains that end in cycles, and eight hubs every fifth document points to."""
    d = table(spark, sf, "documents").select("doc_id")
    n = F.col("doc_id")
    onward = F.when(n % 16 != 15, n + 1).otherwise(n - 7)
    return d.select(n.alias("src"), F.explode(F.when(n % 5 == 0, F.array(onward, n * 7 % 8)).otherwise(F.array(onward))).alias("dst"))


def ref_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a trigger on what they refer to."""
    return table(spark, sf, "labels").filter("toxic = 1").select("doc_id")


REFS = """refs AS (
  SELECT doc_id AS src, CASE WHEN doc_id % 16 <> 15 THEN doc_id + 1 ELSE doc_id - 7 END AS dst FROM documents
  UNION ALL
  SELECT doc_id AS src, doc_id * 7 % 8 AS dst FROM documents WHERE doc_id % 5 = 0)"""

# what the owners of triggers refer to, over one reference or more
CLOSURE = """closure(owner, node) AS (
  SELECT src, dst FROM refs WHERE src IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION
  SELECT c.owner, r.dst FROM closure c JOIN refs r ON r.src = c.node)"""


# -- paths ------------------------------------------------------------------


def paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url")
    mount = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    rel = F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1)
    return p.select("page_id", "url", mount.alias("mount"), rel.alias("rel"),
                    F.concat(F.lit("/"), mount, F.lit("/"), rel).alias("id"))


PATHS = """paths AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS mount,
         regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS rel,
         '/' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' ||
         regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS id
  FROM pages)"""


# -- links ------------------------------------------------------------------


def vault(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as markdown files of one vault, with links into it; some dangle."""
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    n = table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    k = ((F.col("doc_id") * 7 + 1) % (n + 50)).cast("string")
    own = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    body = F.concat(
        F.col("text"), F.lit("\n\nSee [["), k, F.lit("#sec|alias]] and [t](./"), k, F.lit(".md) #Topic-"),
        F.col("lang"), F.lit(" #123"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\n[["), own, F.lit("]]"))).otherwise(""))
    return d.select(
        F.concat(F.lit("/vault/"), own, F.lit(".md")).alias("id"), F.lit("vault").alias("mount"),
        F.concat(own, F.lit(".md")).alias("rel"), "source", body.alias("text"))


VAULT = """vault AS (
  SELECT '/vault/' || source || '/' || doc_id || '.md' AS id, 'vault' AS mount,
         source || '/' || doc_id || '.md' AS rel, source,
         text || chr(10) || chr(10) || 'See [[' || k || '#sec|alias]] and [t](./' || k || '.md) #Topic-' || lang
         || ' #123' || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '[[' || source || '/' || doc_id || ']]' ELSE '' END AS text
  FROM (SELECT *, (doc_id * 7 + 1) % ((SELECT count(*) FROM documents) + 50) AS k FROM documents))"""

LINKS = r"""links AS (
  SELECT DISTINCT src, link FROM (
    SELECT id AS src, regexp_extract(unnest(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1)), '^([^#|]*)', 1) AS link
    FROM vault
    UNION ALL
    SELECT id, source || '/' || regexp_replace(unnest(regexp_extract_all(text, '\[[^\[]+\]\(([^)]+)\)', 1)), '^\./', '')
    FROM vault))"""


# -- messages ---------------------------------------------------------------


def _message_date() -> Column:
    return minutes_after(F.col("conv_id") * 60 + F.col("turn"))


def messages(spark: SparkSession, sf: str, encoded: bool = False) -> DataFrame:
    """Conversation turns as mail; CRLF line ends on odd turns, a date on all but the user's.

    With ``encoded`` the subjects of some turns are encoded words.
    """
    c = spread(table(spark, sf, "conversations"), "conv_id", "turn")
    other = F.when(F.col("role") == "user", "assistant").otherwise("user")
    subject = F.trim(F.substring(F.regexp_replace("text", r"[\r\n]+", " "), 1, 90))
    if encoded:
        data = F.encode(subject, "UTF-8")
        quoted = F.regexp_replace(F.hex(data), "(..)", "=$1")
        subject = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("=?UTF-8?B?"), F.regexp_replace(F.base64(data), r"\s", ""), F.lit("?="))).when(
            F.col("turn") % 3 == 1, F.concat(F.lit("=?utf-8?q?"), quoted, F.lit("?="))).otherwise(subject)
    date = F.when(F.col("role") != "user", F.concat(
        F.lit("Date: "), F.date_format(_message_date(), "d MMM yyyy HH:mm:ss"), F.lit(" +0000\n"))).otherwise("")
    raw = F.concat(
        F.lit("From: "), F.col("role"), F.lit(" <"), F.col("role"), F.lit("@example.com>\nTo: "), other,
        F.lit("@example.com\nMessage-ID: "), F.col("conv_id").cast("string"), F.lit("-"),
        F.col("turn").cast("string"), F.lit("\n"), date, F.lit("Subject: "), subject, F.lit("\n\n"), F.col("text"))
    return c.select(
        "conv_id", "turn", "role",
        F.when(F.col("turn") % 2 == 1, F.replace(raw, F.lit("\n"), F.lit("\r\n"))).otherwise(raw).alias("text"))


MSG = r"""msg AS (
  SELECT conv_id, turn, role, text AS body,
         trim(substring(regexp_replace(text, '[\r\n]+', ' ', 'g'), 1, 90)) AS subject,
         CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END || '@example.com' AS recipient,
         CASE WHEN role <> 'user' THEN TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) END AS date
  FROM conversations)"""


# -- changes and triggers ---------------------------------------------------


def hour_of(ts: Column) -> Column:
    return F.floor((micros(ts) - micros(ntz(EPOCH))) / 3_600_000_000).cast("bigint")


def ops(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of users, documents and saved queries; one transaction is one hour."""
    users = tx(spark, sf).select(
        hour_of(F.col("tx_time")).alias("tx_id"), F.col("tx_id").alias("op_seq"), "op", "id")
    put = F.lit("put").alias("op")
    notes = documents(spark, sf).select(
        F.floor(F.col("doc_id") / 60).cast("bigint").alias("tx_id"), F.col("doc_id").alias("op_seq"), put, "id")
    saved = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("tx_id"), F.col("item_id").alias("op_seq"), put,
        F.concat(F.lit("/queries/"), F.col("item_id").cast("string"), F.lit(".query.tide.edn")).alias("id"))
    return users.unionByName(notes).unionByName(saved)


OPS = """ops AS (
  SELECT epoch_us(tx_time - INTERVAL 0 SECOND) // 3600000000 - epoch_us(TIMESTAMP '2024-01-01') // 3600000000 AS tx_id,
         tx_id AS op_seq, op, id FROM tx
  UNION ALL SELECT doc_id // 60, doc_id, 'put', id FROM docs
  UNION ALL SELECT item_id, item_id, 'put', '/queries/' || item_id || '.query.tide.edn' FROM benchmark)"""

PATTERNS = ["/users/1*", "/users/*", "/users/{2,3}?", "/docs/**.fr", "**.log", "/docs/src1/[!1-4]*"]


def _trigger(kind: str, idx: int = 0, vector: bool = False, self_id: Column | None = None,
             glob: str | None = None, has_call: bool = True) -> Column:
    return F.struct(
        (F.lit(None).cast("string") if self_id is None else self_id).alias("self_id"),
        F.lit(kind).alias("on_k"), F.lit(idx).alias("idx"), F.lit(vector).alias("is_vector"),
        F.lit(glob).cast("string").alias("glob"), F.lit(has_call).alias("has_call"))


def triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Triggers that users, documents and a few fixed documents carry."""
    no_tx = F.lit(None).cast("bigint").alias("from_tx")
    by_segment = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(_trigger("modify")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.array(_trigger("modify", 0, True), _trigger("modify", 1, True)))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(_trigger("startup"), _trigger("shutdown")))
    )
    users = table(spark, sf, "customer").select(
        F.concat(F.lit("/users/"), F.col("c_custkey").cast("string")).alias("self_id"),
        F.explode(by_segment).alias("t"),
    ).select("self_id", "t.on_k", "t.idx", "t.is_vector", "t.glob", "t.has_call", no_tx)
    named = lambda kind, i: F.lit(f"/triggers/{kind}-{i}")
    fixed = F.array(
        *[_trigger("pattern", self_id=named("pattern", i), glob=g) for i, g in enumerate(PATTERNS)],
        *[_trigger("tx", self_id=named("tx", i)) for i in range(2)],
        *[_trigger("query", self_id=named("query", i), has_call=i == 0) for i in range(2)])
    own = spark.range(1).select(F.explode(fixed).alias("t")).select("t.*", no_tx)
    toxic = documents(spark, sf).join(
        table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select(
        F.col("id").alias("self_id"), F.lit("refs").alias("on_k"), F.lit(0).alias("idx"),
        F.lit(False).alias("is_vector"), F.lit(None).cast("string").alias("glob"), F.lit(True).alias("has_call"),
        F.floor(F.col("doc_id") * 37 % 1440 / 60).cast("bigint").alias("from_tx"))
    return users.unionByName(own).unionByName(toxic)


# the oracle's own regular expressions for PATTERNS
_PATTERN_REGEX = [
    r"^/users/1[^/]*$", r"^/users/[^/]*$", r"^/users/(2|3)[^/]$", r"^/docs/.*\.fr$", r"^.*\.log$",
    r"^/docs/src1/[^1-4/][^/]*$",
]
_PATTERN_TABLE = ", ".join(f"({i}, '{r}')" for i, r in enumerate(_PATTERN_REGEX))

TRIG = f"""trig AS (
  SELECT '/users/' || c_custkey AS self_id, 'modify' AS on_k, 0 AS idx, false AS is_vector, CAST(NULL AS BIGINT) AS from_tx
  FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT '/users/' || c_custkey, 'modify', i, true, NULL FROM customer, (VALUES (0), (1)) v(i)
  WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT '/users/' || c_custkey, kind, 0, false, NULL FROM customer, (VALUES ('startup'), ('shutdown')) v(kind)
  WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL SELECT id, 'refs', 0, false, doc_id * 37 % 1440 // 60 FROM docs WHERE toxic = 1
  UNION ALL SELECT '/triggers/tx-' || i, 'tx', 0, false, NULL FROM (VALUES (0), (1)) v(i)),
globs AS (SELECT '/triggers/pattern-' || i AS self_id, regex FROM (VALUES {_PATTERN_TABLE}) v(i, regex))"""


def doc_closure(spark: SparkSession, sf: str, closure: DataFrame) -> DataFrame:
    """A closure (owner, node) over document numbers as (seed, node) over ids: changed document and owner."""
    named = documents(spark, sf).select("doc_id", "id")
    a = named.select(F.col("doc_id").alias("owner"), F.col("id").alias("__owner"))
    b = named.select(F.col("doc_id").alias("node"), F.col("id").alias("seed"))
    return closure.join(a, "owner").join(b, "node").select("seed", F.col("__owner").alias("node"))
