"""References, folders, links and nested documents."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.functions import paths as P, text as X
from tidemark.operators import explode as Ex, graph as G, pull as Pl
from tidemark.operators.ordered import tx_bucket
from tidemark.plans import inputs as I
from tidemark.plans.registry import register
from tidemark.sources import files as Fs, markdown as Md

QUERIES: dict = {}
query = functools.partial(register, QUERIES)


@query(f"WITH RECURSIVE {I.REFS}, {I.CLOSURE} SELECT owner, node FROM closure")
def refs_closure(spark, sf):
    """What documents with a trigger on references refer to, however far."""
    owners = I.ref_owners(spark, sf).select(F.col("doc_id").alias("seed"))
    return G.forward_closure(owners, I.refs(spark, sf)).select(F.col("seed").alias("owner"), "node")


@query(f"""WITH {I.REFS} SELECT src, count(*) OVER (PARTITION BY src) AS n_refs,
  row_number() OVER (PARTITION BY src ORDER BY dst) AS pos, dst FROM (SELECT DISTINCT src, dst FROM refs)""")
def collect_refs(spark, sf):
    # both kinds of link in one set, nothing collapsed twice
    distinct = I.refs(spark, sf).filter(F.col("dst").isNotNull()).distinct()
    items = Pl.numbered(distinct, ["src"], ["dst"], tx_bucket(F.col("dst")))
    counts = distinct.groupBy("src").agg(F.count("*").alias("n_refs"))
    return items.join(counts, "src").select("src", "n_refs", "pos", "dst")


@query(f"""WITH RECURSIVE {I.PATHS}, up(id, folder, depth) AS (
  SELECT DISTINCT id, regexp_replace(id, '/[^/]*$', ''), 1 FROM paths
  UNION ALL SELECT id, regexp_replace(folder, '/[^/]*$', ''), depth + 1 FROM up WHERE folder <> '')
SELECT folder, id, depth FROM up WHERE folder <> ''""")
def parent_descendants(spark, sf):
    ids = I.paths(spark, sf).select("id").distinct()
    folders = Fs.folder_docs(ids).select(F.col("id").alias("folder"))
    return G.descendants(folders, ids)


@query(f"""WITH {I.VAULT}, {I.LINKS},
tags AS (SELECT DISTINCT id AS src, lower(unnest(regexp_extract_all(text, '#([\\p{{L}}\\d_/-]+)', 1))) AS link FROM vault)
SELECT 'link' AS kind, src, link FROM links
UNION ALL SELECT 'tag', src, link FROM tags WHERE regexp_matches(link, '\\p{{L}}')""")
def link_extract(spark, sf):
    v = I.vault(spark, sf)
    links = Md.links_of(v).select(F.lit("link").alias("kind"), "src", "link")
    tags = v.select(F.lit("tag").alias("kind"), F.col("id").alias("src"),
                    F.explode(F.array_distinct(X.hashtags(F.col("text")))).alias("link"))
    return links.unionByName(tags)


@query(f"""WITH {I.VAULT}, {I.LINKS}, files AS (SELECT rel FROM vault),
hits AS (SELECT link, rel FROM (SELECT DISTINCT link FROM links) JOIN files
         ON ends_with(rel, link) OR ends_with(rel, link || '.md')),
best AS (SELECT link, arg_min(rel, lpad(CAST(length(rel) AS VARCHAR), 9, '0') || rel) AS target FROM hits GROUP BY link)
SELECT DISTINCT src, '/vault/' || target AS dst FROM links JOIN best USING (link)""")
def link_resolve(spark, sf):
    v = I.vault(spark, sf)
    return Md.markdown_refs(v, v)


@query("""WITH d AS (
  SELECT '/orders/' || o_orderkey AS source, o_orderkey, o_orderstatus, c_custkey, c_name, n_name, n_regionkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT '/orders/' || l_orderkey AS source, l_partkey, l_linenumber,
        '/orders/' || l_orderkey || '.explode/lines.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) || '.edn' AS id
      FROM lineitem),
ls AS (SELECT source, string_agg('"' || id || '"', ',' ORDER BY l_linenumber, l_partkey) AS lines FROM l GROUP BY 1)
SELECT source, id, '{"number":' || l_linenumber || ',"part":' || l_partkey || '}' AS doc FROM l JOIN d USING (source)
UNION ALL SELECT source, source || '.explode/root.edn' AS id,
  '{"customer":"' || source || '.explode/customer.edn","key":' || o_orderkey || ',"lines":[' || coalesce(lines, '') || '],"status":"' || o_orderstatus || '"}' AS doc
  FROM d LEFT JOIN ls USING (source)
UNION ALL SELECT source, source || '.explode/customer.edn',
  '{"id":' || c_custkey || ',"name":"' || c_name || '","nation":"' || source || '.explode/customer.nation.edn"}' FROM d
UNION ALL SELECT source, source || '.explode/customer.nation.edn',
  '{"name":"' || n_name || '","region":' || n_regionkey || '}' FROM d""")
def doc_explode(spark, sf):
    n = I.table(spark, sf, "nation").select(
        "n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"))
    c = I.spread(I.table(spark, sf, "customer"), "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "nation").alias("customer"))
    # an order has a handful of lines, in one list
    lines = I.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part")))).alias("lines"))
    o = I.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<struct<number:bigint,part:bigint>>")
    nested = o.select(
        F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")).alias("id"),
        F.to_variant_object(F.struct(
            F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "customer",
            F.coalesce(F.col("lines").cast("array<struct<number:bigint,part:bigint>>"), none).alias("lines"))).alias("doc"))
    return Ex.explode_nested(nested).withColumn("doc", F.to_json("doc"))


@query(f"""WITH {I.PATHS} SELECT page_id, mount, rel, id, regexp_replace(id, '/[^/]*$', '') AS parent,
  regexp_extract(id, '^/([^/]+)/', 1) AS mount_again,
  nullif(regexp_extract(mount, '[^/]\\.([^./]+)$', 1), '') AS ext, id || '.meta.edn' AS sidecar,
  '/data/' || mount || '/' || rel AS path FROM paths""")
def mount_ids(spark, sf):
    p = I.paths(spark, sf)
    full = F.concat(F.lit("/data/"), F.col("mount"), F.lit("/"), F.col("rel"))
    key = P.doc_id(F.col("mount"), F.col("rel"))
    return p.select(
        "page_id", "mount", "rel", key.alias("id"), P.parent_of(key).alias("parent"),
        P.mount_of(key).alias("mount_again"), P.extension(F.col("mount")).alias("ext"),
        P.sidecar_path(key).alias("sidecar"), full.alias("path"))


@query(f"""WITH {I.PATHS} SELECT id FROM paths
WHERE NOT regexp_matches(rel, '(^|/)(\\.DS_Store|\\.git|\\.gitignore|\\.obsidian|\\.vscode|node_modules|target|\\.cpcache|fr|de)(/|$)')""")
def ignore_filter(spark, sf):
    return I.paths(spark, sf).filter(~P.is_ignored(F.col("rel"), P.ignore_list(extra=["fr", "de"]))).select("id")


GLOBS = [
    ("/**/fr/*", r"^/.*/fr/[^/]*$"),
    ("/m.*/en/**", r"^/m\.[^/]*/en/.*$"),
    ("/*.example.org/*/6?", r"^/[^/]*\.example\.org/[^/]*/6[^/]$"),
    ("/{www,m}.**", r"^/(www|m)\..*$"),
    ("/*/[de]*/[!1]*", r"^/[^/]*/[de][^/]*/[^1/][^/]*$"),
    ("**9", r"^.*9$"),
    ("**.log", r"^.*\.log$"),
]
_GLOB_ROWS = ", ".join(f"('{g}', '{r}')" for g, r in GLOBS)


@query(f"""WITH {I.PATHS}, globs AS (SELECT * FROM (VALUES {_GLOB_ROWS}) v("glob", regex))
SELECT page_id, id, "glob" FROM paths JOIN globs ON regexp_matches(id, regex)""")
def glob_match(spark, sf):
    from tidemark.operators.triggers import match_globs

    globs = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g, _ in GLOBS])).alias("glob"))
    return match_globs(I.paths(spark, sf).select("page_id", "id"), globs)


@query(f"""WITH {I.PATHS} SELECT page_id, id FROM paths WHERE regexp_matches(id, '^/[^/]*/en/[^/]*$')""")
def force_read(spark, sf):
    return I.paths(spark, sf).filter(P.matches_glob(F.col("id"), "/*/en/*")).select("page_id", "id")
