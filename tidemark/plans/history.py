"""Versioned store: history, snapshots, diffs, merges."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.functions.values import doc_hash
from tidemark.operators import asof, merge as Mg, ordered as O, store as St
from tidemark.plans import inputs as I
from tidemark.plans.registry import register
from tidemark.sources import feeds

QUERIES: dict = {}
query = functools.partial(register, QUERIES)


@query(f"""WITH {I.TX} SELECT id, tx_id, op, {I.sql_ts('tx_time')} AS valid_from,
  {I.sql_ts('lead(tx_time) OVER (PARTITION BY id ORDER BY tx_id)')} AS valid_to FROM tx""")
def entity_history(spark, sf):
    h = St.history(I.tx(spark, sf).select("tx_id", "tx_time", "op", "id"))
    return h.select("id", "tx_id", "op", I.ts_text("valid_from").alias("valid_from"),
                    I.ts_text("valid_to").alias("valid_to"))


@query(f"""WITH {I.TX}, v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_id DESC) AS rn FROM tx)
SELECT id, tx_id, type, value, k FROM v WHERE rn = 1 AND op = 'put'""")
def entity_current(spark, sf):
    return St.as_of(I.tx(spark, sf)).select("id", "tx_id", "type", "value", "k")


@query(f"""WITH {I.TX}, v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_id DESC) AS rn FROM tx
  WHERE tx_time <= TIMESTAMP '{I.HALF}')
SELECT id, tx_id, type, value, k FROM v WHERE rn = 1 AND op = 'put'""")
def db_as_of(spark, sf):
    return St.as_of(I.tx(spark, sf), time=I.ntz(I.HALF)).select("id", "tx_id", "type", "value", "k")


@query(f"""WITH {I.TX} SELECT v.id, v.tx_id, p.tx_id AS purchase_tx, p.value AS purchase_value
FROM (SELECT * FROM tx WHERE type = 'view') v ASOF JOIN (SELECT * FROM tx WHERE type = 'purchase') p
ON v.id = p.id AND v.tx_time >= p.tx_time""")
def as_of_join(spark, sf):
    t = I.tx(spark, sf).select("id", "tx_time", "tx_id", "type", "value")
    views = t.filter(F.col("type") == "view").select("id", "tx_time", "tx_id")
    buys = t.filter(F.col("type") == "purchase")
    out = asof.as_of_join(views, buys, "id", "tx_time", O.tx_bucket(F.col("tx_id")),
                          {"purchase_tx": "tx_id", "purchase_value": "value"}, how="inner")
    return out.select("id", "tx_id", "purchase_tx", "purchase_value")


@query(f"""WITH {I.TX}, s AS (SELECT *, CASE WHEN op = 'put' THEN type END AS state FROM tx),
p AS (SELECT *, lag(state) OVER w AS prev, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY id ORDER BY tx_id))
SELECT id, tx_id, rn = 1 AS is_first, sha1('{{"k":' || coalesce(CAST(k AS VARCHAR), 'null') || ',"type":"' || type || '"}}') AS content_hash FROM p
WHERE rn = 1 OR state IS DISTINCT FROM prev""")
def history_diff(spark, sf):
    t = I.tx(spark, sf)
    changed = St.history_changes(t, F.when(F.col("op") == "put", F.col("type")))
    doc = F.to_variant_object(F.struct("type", "k"))
    return changed.select("id", "tx_id", "is_first", doc_hash(doc).alias("content_hash"))


@query(f"""WITH {I.TX} SELECT tx_id, op, id FROM tx WHERE NOT coalesce(type = 'click' AND value > 40, false)
AND type <> 'signup' AND value >= 2""")
def tx_ops_normalise(spark, sf):
    t = I.tx(spark, sf)
    raw = (
        t.withColumn("committed", F.when(F.col("value") < 2, False).when(F.col("value") < 50, True))
        .withColumn("valid_time", F.when(F.col("type") == "signup", F.col("tx_time")))
        .withColumn("ignore", F.when(F.col("type") == "click", F.col("value") > 40))
    )
    return St.normalise_ops(raw).select("tx_id", "op", "id")


def _snapshots(spark, sf):
    t = I.tx(spark, sf).select("tx_id", "tx_time", "op", "id")
    seen = St.as_of(t, columns=["tx_time"]).select("id", F.col("tx_time").alias("modified"))
    stored = St.as_of(t, time=I.ntz(I.HALF), columns=["tx_time"]).select("id", F.col("tx_time").alias("modified"))
    return seen, stored


_SNAPSHOTS = f"""{I.TX}, seen AS (
  SELECT id, tx_time AS modified FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_id DESC) AS rn FROM tx)
  WHERE rn = 1 AND op = 'put'),
stored AS (
  SELECT id, tx_time AS modified FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_id DESC) AS rn FROM tx
  WHERE tx_time <= TIMESTAMP '{I.HALF}') WHERE rn = 1 AND op = 'put')"""


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(a.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'deleted' ELSE 'changed' END AS status,
  {I.sql_ts('a.modified')} AS seen, {I.sql_ts('b.modified')} AS stored
FROM seen a FULL JOIN stored b ON a.id = b.id WHERE a.modified IS DISTINCT FROM b.modified""")
def stale_diff(spark, sf):
    return St.stale(*_snapshots(spark, sf)).select(
        "id", "status", I.ts_text("seen").alias("seen"), I.ts_text("stored").alias("stored"))


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'delete' ELSE 'put' END AS op,
  {I.sql_ts('a.modified')} AS modified
FROM seen a FULL JOIN stored b ON a.id = b.id WHERE a.modified IS DISTINCT FROM b.modified""")
def sync_once(spark, sf):
    ops = St.sync_ops(*_snapshots(spark, sf))
    return ops.select("id", "op", I.ts_text("modified").alias("modified"))


@query(f"""WITH {I.TX}, late AS (SELECT * FROM tx WHERE tx_id >= (SELECT min(tx_id) FROM tx WHERE tx_time >= TIMESTAMP '{I.HALF}')),
known AS (SELECT DISTINCT md5(id) AS id_hash, id FROM tx WHERE op = 'put')
SELECT tx_id, op, id FROM late WHERE op = 'put'
UNION ALL SELECT tx_id, op, known.id FROM late LEFT JOIN known ON md5(late.id) = id_hash WHERE op = 'delete'""")
def tx_log_from(spark, sf):
    t = I.tx(spark, sf).select("tx_id", "tx_time", "op", "id")
    start = t.filter(F.col("tx_time") >= I.ntz(I.HALF)).agg(F.min("tx_id")).scalar()
    late = St.log_from(t, start)
    deletes = late.filter(F.col("op") == "delete").select("tx_id", "op", F.md5("id").alias("id_hash"))
    named = St.resolve_deletes(deletes, t, F.md5("id")).select("tx_id", "op", "id")
    return late.filter(F.col("op") == "put").select("tx_id", "op", "id").unionByName(named)


@query(f"""WITH {I.DOCS} SELECT id,
  {I.sql_ts("greatest(TIMESTAMP '2024-01-01' + to_minutes(doc_id), CASE WHEN quality IS NOT NULL THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 1440) END)")} AS modified,
  lang, n_chars, quality,
  CASE WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'reviewed' END
       WHEN n_chars < 500 THEN 'draft' ELSE 'full' END AS status FROM docs""")
def content_sidecar_merge(spark, sf):
    d = I.documents(spark, sf)
    content = d.select(
        "id", I.minutes_after(F.col("doc_id")).alias("modified"), "lang", "n_chars",
        F.when(F.col("n_chars") < 500, "draft").otherwise("full").alias("status"))
    sidecar = d.join(I.table(spark, sf, "labels"), "doc_id").select(
        "id", I.minutes_after(F.col("doc_id") * 37 % 1440).alias("modified"), "quality",
        F.when(F.col("quality") == 1, "reviewed").alias("status"),
        F.array(F.lit("quality"), F.lit("status")).alias("keys"))
    merged = Mg.overlay_sidecar(content, sidecar, ["lang", "n_chars", "quality", "status"])
    return merged.withColumn("modified", I.ts_text("modified"))


@query(f"""WITH {I.DOCS}, pairs AS (
  SELECT id, 'lang' AS key, 0 AS prio, lang AS value FROM docs
  UNION ALL SELECT id, 'size', 0, CAST(n_chars AS VARCHAR) FROM docs
  UNION ALL SELECT id, 'lang', 1, upper(lang) FROM docs WHERE quality IS NOT NULL
  UNION ALL SELECT id, 'quality', 1, CAST(quality AS VARCHAR) FROM docs WHERE quality IS NOT NULL
  UNION ALL SELECT id, 'lang', 2, NULL FROM docs WHERE toxic = 1)
SELECT id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY prio DESC) AS rn FROM pairs) WHERE rn = 1""")
def reader_merge_priority(spark, sf):
    d = I.docs(spark, sf)
    pair = lambda key, prio, value: F.struct(
        F.lit(key).alias("key"), F.lit(prio).alias("prio"), value.cast("string").alias("value"))
    labelled = F.col("quality").isNotNull()
    # each source's pairs in one pass over the documents
    pairs = F.filter(F.array(
        F.struct(F.lit(True).alias("on"), pair("lang", 0, F.col("lang")).alias("p")),
        F.struct(F.lit(True).alias("on"), pair("size", 0, F.col("n_chars")).alias("p")),
        F.struct(labelled.alias("on"), pair("lang", 1, F.upper("lang")).alias("p")),
        F.struct(labelled.alias("on"), pair("quality", 1, F.col("quality")).alias("p")),
        F.struct((F.coalesce("toxic", F.lit(0)) == 1).alias("on"), pair("lang", 2, F.lit(None)).alias("p")),
    ), lambda x: x["on"])
    rows = d.select("id", F.explode(pairs).alias("x")).select("id", "x.p.*")
    return Mg.merge_pairs(rows)


@query(f"""WITH {I.DOCS} SELECT id, CASE WHEN quality = 1 THEN lang END AS lang,
  n_chars, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS status FROM docs WHERE quality IS NOT NULL""")
def upsert_docs(spark, sf):
    d = I.documents(spark, sf).select("id", "doc_id", "lang", "n_chars", F.lit("raw").alias("status"))
    good = F.col("quality") == 1
    updates = d.select("id", "doc_id").join(I.table(spark, sf, "labels"), "doc_id").select(
        "id",
        F.when(good, F.array(F.lit("status"))).otherwise(F.array(F.lit("status"), F.lit("lang"))).alias("keys"),
        F.when(good, "good").otherwise("poor").alias("status"), F.lit(None).cast("string").alias("lang"))
    return St.upsert(d.drop("doc_id"), updates, ["lang", "status"]).select("id", "lang", "n_chars", "status")


@query(f"""WITH {I.TX} SELECT tx_id, id, type FROM tx WHERE tx_id > 100 ORDER BY tx_id LIMIT 50""")
def incremental_pull(spark, sf):
    return feeds.incremental_pull(I.tx(spark, sf), "tx_id", 100).select("tx_id", "id", "type")


@query(f"""WITH {I.TX} SELECT tx_id, id, type FROM tx WHERE tx_id > 100 ORDER BY tx_id DESC LIMIT 50""")
def incremental_pull_desc(spark, sf):
    return feeds.incremental_pull(I.tx(spark, sf), "tx_id", 100, descending=True).select("tx_id", "id", "type")
