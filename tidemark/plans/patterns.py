"""Pattern queries, pulls, set clauses and aggregates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import aggregate as A, match as M, pull as Pl, search as S
from tidemark.operators.ordered import tx_bucket
from tidemark.operators.skew import join_keys
from tidemark.plans import inputs as I
from tidemark.plans.registry import register

QUERIES: dict = {}
query = functools.partial(register, QUERIES)


@query("SELECT '/docs/' || source || '/' || doc_id || '.' || lang AS id, n_chars FROM documents WHERE lang = 'fr'")
def pattern_const(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).filter(F.col("lang") == "fr").select("id", "n_chars")


@query(f"WITH {I.DOCS} SELECT id, quality FROM docs WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def pattern_exists(spark, sf):
    return M.exists(I.docs(spark, sf), "quality", "toxic").select("id", "quality")


@query(r"""SELECT DISTINCT source, word
FROM (SELECT source, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS word FROM documents) WHERE word <> ''""")
def pattern_multi_valued(spark, sf):
    d = I.spread(I.table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    return M.find(M.each_value(d, F.array_distinct(words), "word"), "source", "word")


@query(r"""SELECT doc_id, lang FROM documents
WHERE list_contains(regexp_split_to_array(text, '[ \t\n\r]+'), 'the')""")
def pattern_any_element(spark, sf):
    d = I.spread(I.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    return d.filter(M.has_value(F.split("text", r"[ \t\n\r]+"), "the")).select("doc_id", "lang")


@query("""SELECT DISTINCT n_name, o_orderpriority FROM customer
JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'""")
def pattern_join(spark, sf):
    c = I.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_nationkey")
    o = I.table(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    n = I.table(spark, sf, "nation").select("n_nationkey", "n_name")
    # the result is a set: order rows shrink to distinct tuples before the last join
    pairs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority").distinct()
    return M.find(pairs.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "n_name", "o_orderpriority")


@query(f"""WITH {I.TX} SELECT id, tx_id, value FROM tx
WHERE CAST(tx_time AS DATE) BETWEEN DATE '2024-01-12' AND DATE '2024-01-18'""")
def pattern_predicate(spark, sf):
    t = I.tx(spark, sf)
    centre = F.lit("2024-01-15").cast("date")
    return t.filter(M.around(F.to_date("tx_time"), centre)).select("id", "tx_id", "value")


@query(f"""WITH {I.DOCS} SELECT id, a.attr, CAST(CASE a.attr WHEN 'lang' THEN lang WHEN 'n_chars' THEN CAST(n_chars AS VARCHAR)
  WHEN 'quality' THEN CAST(quality AS VARCHAR) ELSE CAST(toxic AS VARCHAR) END AS VARCHAR) AS value
FROM docs, (VALUES ('lang'), ('n_chars'), ('quality'), ('toxic')) a(attr)
WHERE a.attr IN ('lang', 'n_chars') OR quality IS NOT NULL""")
def document_triples(spark, sf):
    d = I.docs(spark, sf)
    doc = F.try_parse_json(F.to_json(F.struct("lang", "n_chars", "quality", "toxic")))
    t = M.triples(d.select("id", doc.alias("doc")))
    return t.select("id", "attr", F.try_variant_get("value", "$", "string").alias("value"))


@query("""SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def pull_subset(spark, sf):
    c = I.table(spark, sf, "customer")
    ids = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return Pl.pull_many(c, ids, ["c_name", "c_acctbal"], "c_custkey").withColumn(
        "c_acctbal", F.round("c_acctbal", 4))


@query("""SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def pull_forward(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    # nested pulls go inside out, so the large side is joined once
    c = Pl.pull_ref(I.table(spark, sf, "customer"), "c_nationkey", I.table(spark, sf, "nation"), "n_nationkey",
                    {"nation": "n_name"})
    return Pl.pull_ref(o, "o_custkey", c, "c_custkey", {"customer": "c_name", "nation": "nation"}).drop("o_custkey")


@query("""SELECT n_name, c_name AS customer, c_mktsegment AS segment FROM nation
LEFT JOIN customer ON c_nationkey = n_nationkey""")
def pull_reverse(spark, sf):
    n = I.table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = I.table(spark, sf, "customer")
    return Pl.pull_reverse(n, "n_nationkey", c, "c_nationkey", {"customer": "c_name", "segment": "c_mktsegment"}).select(
        "n_name", "customer", "segment")


@query("""SELECT n_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, c_name AS customer
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def pull_reverse_nested(spark, sf):
    n = I.table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = I.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    items = Pl.numbered(c, ["c_nationkey"], ["c_custkey"], tx_bucket(F.col("c_custkey")), hot_rows=200)
    named = items.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "pos", F.col("c_name").alias("customer"))


@query(f"""WITH {I.DOCS} SELECT id FROM docs WHERE lang = 'fr' UNION SELECT id FROM docs WHERE toxic = 1
UNION SELECT id FROM docs WHERE n_chars < 200""")
def or_clause(spark, sf):
    return M.clause_or(
        I.docs(spark, sf), F.col("lang") == "fr", F.col("toxic") == 1, F.col("n_chars") < 200).select("id")


@query(f"WITH {I.DOCS} SELECT id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_clause(spark, sf):
    return M.clause_not(I.documents(spark, sf), I.table(spark, sf, "labels").select("doc_id"), "doc_id").select("id")


@query(f"""WITH {I.DOCS} SELECT id FROM docs d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def exists_clause(spark, sf):
    toxic = I.table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return M.clause_exists(I.documents(spark, sf), toxic, "doc_id").select("id")


@query(f"""WITH {I.TX} SELECT type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS lo, max(value) AS hi,
  round(avg(value), 4) AS mean, count(DISTINCT id) AS n_ids, round(median(value), 4) AS mid,
  round(var_pop(value), 4) AS variance, round(stddev_pop(value), 4) AS deviation FROM tx GROUP BY type""")
def datalog_aggregates(spark, sf):
    t = I.tx(spark, sf)
    basic = t.groupBy("type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.var_pop("value"), 4).alias("variance"), F.round(F.stddev_pop("value"), 4).alias("deviation"))
    ids = A.count_distinct(t, ["type"], "id", "n_ids")
    mid = A.median(t, ["type"], "value", width=1.0).withColumn("mid", F.round("median", 4)).drop("median")
    return join_keys(join_keys(basic, ids, ["type"], "left"), mid, ["type"], "left")


@query(f"""WITH {I.TX} SELECT type, date_trunc('day', tx_time)::DATE::VARCHAR AS day,
  date_trunc('week', tx_time)::DATE::VARCHAR AS week,
  count(*) AS n, round(sum(value), 4) AS total FROM tx GROUP BY ALL""")
def window_totals(spark, sf):
    t = I.tx(spark, sf).withColumn("day", F.to_date("tx_time"))
    days = t.groupBy("type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return days.select("type", F.col("day").cast("string").alias("day"),
                       F.to_date(F.date_trunc("week", "day")).cast("string").alias("week"), "n", "total")


@query("""SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10""")
def query_limit(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).withColumn(
        "o_totalprice", F.round("o_totalprice", 4))


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND n_chars >= 500 AND n_chars < 2000")
def param_query(spark, sf):
    return spark.sql(
        "SELECT doc_id, n_chars FROM {docs} WHERE lang = :lang AND n_chars >= :lo AND n_chars < :hi",
        args={"lang": "de", "lo": 500, "hi": 2000}, docs=I.table(spark, sf, "documents"))


@query(f"""WITH {I.DOCS} SELECT id, parent, doc_id, lang, source, n_chars, quality, toxic FROM docs""")
def all_docs(spark, sf):
    return I.docs(spark, sf).select("id", "parent", "doc_id", "lang", "source", "n_chars", "quality", "toxic")


TERMS = ["the", "der", "que", "ou", "nicht"]


@query(r"""WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM toks WHERE t IN ('the', 'der', 'que', 'ou', 'nicht') GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t)
SELECT doc_id, round(sum(tf * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE))), 4) AS score
FROM tf JOIN df USING (t) GROUP BY doc_id""")
def text_search(spark, sf):
    d = I.spread(I.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return S.text_search(d, "text", TERMS).select("doc_id", F.round("score", 4).alias("score"))
