"""One document from several sources: sidecar overlay and reader priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def overlay_sidecar(content: DataFrame, sidecar: DataFrame, attrs: list[str]) -> DataFrame:
    """Full outer join of content and sidecar rows on ``id``.

    A document exists when either file does. Sidecar attributes win by presence:
    a sidecar row lists the names it sets in ``keys`` (all non-null ones without
    that column). ``modified`` is the later of the two.
    """
    by_keys = "keys" in sidecar.columns
    s = sidecar.select(
        "id", F.col("modified").alias("__m"), *( [F.col("keys").alias("__keys")] if by_keys else []),
        *[F.col(a).alias(f"__{a}") for a in attrs if a in sidecar.columns])

    def merged(a: str) -> Column:
        if a not in sidecar.columns:
            return F.col(a)
        if a not in content.columns:
            return F.col(f"__{a}").alias(a)
        if by_keys:
            wins = F.coalesce(F.array_contains("__keys", F.lit(a)), F.lit(False))
            return F.when(wins, F.col(f"__{a}")).otherwise(F.col(a)).alias(a)
        return F.coalesce(F.col(f"__{a}"), F.col(a)).alias(a)

    return content.join(s, "id", "full_outer").select(
        "id", F.greatest("modified", "__m").alias("modified"), *[merged(a) for a in attrs])


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """``(id, key, prio, value)`` → the value of the highest priority per (id, key).

    A null value of higher priority still wins: presence counts, not the value.
    """
    return pairs.groupBy("id", "key").agg(
        F.max_by(F.struct("value"), "prio").alias("v")).select("id", "key", "v.value")


def merge_documents(docs: DataFrame) -> DataFrame:
    """Shallow merge of VARIANT documents ``(id, prio, doc)``: top-level keys, last source wins.

    Rows are regrouped twice, by (id, key) and by id; both groups are bounded by
    the size of one document.
    """
    pairs = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    return to_documents(merge_pairs(pairs.select("id", "prio", "key", "value")))


def to_documents(pairs: DataFrame) -> DataFrame:
    """``(id, key, value VARIANT)`` → ``(id, doc VARIANT)``."""
    return pairs.groupBy("id").agg(
        F.to_variant_object(
            F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("doc"))


def strip_empty(pairs: DataFrame) -> DataFrame:
    """Drop pairs whose VARIANT value is null or an empty collection."""
    empty = F.col("value").isNull() | F.is_variant_null("value") | F.to_json(F.col("value")).isin("[]", "{}")
    return pairs.filter(~empty)
