"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import read_table
from tidemark.plans.registry import register

QUERIES: dict = {}


@register(QUERIES)
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores of all documents."""
    ops = importlib.import_module("tidemark.llm.rule_ensemble")
    scored = ops.classify(read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register(QUERIES)
def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all documents, and digests of the ids and of what they decode to."""
    import public_tokenizers

    ops = importlib.import_module("tidemark.llm.bpe")
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    coded = ops.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", ops.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@register(QUERIES)
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all documents and the verdict of the learned decision list."""
    ops = importlib.import_module("tidemark.llm.decision_list")
    judged = ops.judge(read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "labels"))
    counts = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, ops.base_failed().alias("base_failed"),
                         (~ops.base_failed() & (F.col("rule") == 0)).alias("kept"), "rule")


@register(QUERIES)
def op4_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and templates in all documents."""
    ops = importlib.import_module("tidemark.llm.licenses")
    found = ops.scan_licenses(read_table(spark, sf, "documents").select("doc_id", "text"))
    base, all_ = F.col("licenses.phrases.label"), F.concat("licenses.phrases.label", "licenses.spans.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", F.col("licenses.n_words").alias("n_words"), F.size("licenses.phrases").cast("bigint").alias("n_base"),
        F.array_min("licenses.phrases.first").alias("first_word"), F.array_max("licenses.phrases.first").alias("last_word"),
        joined(base).alias("base_labels"), joined(all_).alias("labels"), F.col("licenses.score").alias("score"))


@register(QUERIES)
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of all documents; ``lang`` is what they declare, ``source`` stands for the host."""
    ops = importlib.import_module("tidemark.llm.language")
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    found = ops.identify(docs, ops.fit(docs, "text", "lang"), declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", F.col("language.guess").alias("language"), F.col("language.posterior").alias("posterior"),
                        F.col("language.accepted").alias("kept"))


@register(QUERIES)
def language_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Language of all pages, by models of the documents, declared language, address suffix and host."""
    ops = importlib.import_module("tidemark.llm.language")
    model = ops.fit(read_table(spark, sf, "documents").select("text", "lang"), "text", "lang")
    host = ops.host_of(F.col("url"))
    pages = read_table(spark, sf, "pages").select("page_id", "url", ops.declared_of(F.col("html")).alias("declared"), F.regexp_replace(
        "html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ").alias("text"))
    found = ops.identify(pages, model, declared=F.col("declared"), host=host, suffix=ops.suffix_of(host))
    return found.select("page_id", "declared", F.col("language.guess").alias("language"),
                        F.col("language.posterior").alias("posterior"), F.col("language.accepted").alias("kept"))


@register(QUERIES)
def op6_html(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of all pages."""
    ops = importlib.import_module("tidemark.llm.html_text")
    text = ops.extract(read_table(spark, sf, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", F.length("text").cast("bigint").alias("n_chars"), "text")


@register(QUERIES)
def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata and conversion records of all pages, taken as responses."""
    ops = importlib.import_module("tidemark.llm.warc")
    return ops.derive(ops.responses_of(read_table(spark, sf, "pages").select("page_id", "url", "html"), key="page_id"))


@register(QUERIES)
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    ops = importlib.import_module("tidemark.llm.simhash")
    groups = ops.near_groups(read_table(spark, sf, "documents").select("doc_id", "text"))
    return groups.select("doc_id", ops.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


# The words of decontamination and of the oracle: A-Z lower-cased, then runs of letters, digits and non-ASCII.
SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP8_SQL = f"""
WITH doc AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
item AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM (SELECT item_id, {SQL_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
pattern AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS p
            FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM item)),
place AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS p
          FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
                FROM doc, (SELECT DISTINCT m FROM pattern) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, item_id, i, m FROM place JOIN pattern USING (m, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register(QUERIES, OP8_SQL)
def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document that stand in a window of a test item."""
    ops = importlib.import_module("tidemark.llm.decontaminate")
    found = ops.find(read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), ops.n_hit().alias("n_hit"),
        F.size("contamination.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.size("contamination.spans") > 0).alias("contaminated"))


@register(QUERIES)
def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated bytes of all documents, and a digest of the rest."""
    ops = importlib.import_module("tidemark.llm.suffix_dedup")
    found = ops.strip(read_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("deduplicated.n_bytes").alias("n_bytes"), ops.n_removed().alias("n_removed"),
                        F.size("deduplicated.spans").cast("bigint").alias("n_spans"), F.sha2("deduplicated.kept", 256).alias("kept_sha256"),
                        (F.size("deduplicated.spans") > 0).alias("repeated"))


@register(QUERIES)
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in all documents, with corpus-wide counts of linked pairs."""
    import public_tokenizers as public

    ops = importlib.import_module("tidemark.llm.token_alignment")
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = ops.align(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)
    numbers = [F.col(f"alignment.{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    groups = F.when(F.col("alignment.groups") == "", "").otherwise(F.sha2(F.col("alignment.groups").cast("binary"), 256))
    return found.select("doc_id", *numbers, groups.alias("groups_sha256"))


@register(QUERIES)
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after damage."""
    ops = importlib.import_module("tidemark.llm.conversations")
    return ops.repair(ops.damage(read_table(spark, sf, "conversations")))


@register(QUERIES)
def op13_katz(spark: SparkSession, sf: str) -> DataFrame:
    """Log probability of all documents under a model of those that are not held out."""
    ops = importlib.import_module("tidemark.llm.katz")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    docs = read_table(spark, sf, "documents").select("doc_id", "text", (remainder == 1).alias("held_out"))
    scored = ops.score(docs, ops.fit(docs.filter(~F.col("held_out"))))
    return scored.select("doc_id", "held_out", *[F.col(f"katz.{c}").alias(c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")])
