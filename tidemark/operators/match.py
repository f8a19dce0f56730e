"""Triple-pattern matching on DataFrames of entities.

A pattern over one entity is a filter on one scan; patterns that share a variable
between entities are equi-joins. Results are sets: ``find`` projects and dedupes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import one_or_many


def has_value(attr: Column, value) -> Column:
    """``[?e attr value]`` on a multi-valued (array) attribute: any element equals it."""
    return F.array_contains(attr, value)


def exists(docs: DataFrame, *attrs: str) -> DataFrame:
    """``[?e attr]``: entities that have every one of the attributes."""
    for a in attrs:
        docs = docs.filter(F.col(a).isNotNull())
    return docs


def each_value(docs: DataFrame, attr: Column, out: str) -> DataFrame:
    """``[?e attr ?v]`` on a multi-valued attribute: one row per element."""
    return docs.withColumn(out, F.explode(attr))


def find(df: DataFrame, *columns) -> DataFrame:
    """``:find``: the distinct tuples of the given variables."""
    return df.select(*columns).distinct()


def clause_or(docs: DataFrame, *conditions: Column) -> DataFrame:
    """Disjunction over one entity: one scan, whatever the number of branches."""
    any_of = conditions[0]
    for c in conditions[1:]:
        any_of = any_of | c
    return docs.filter(any_of)


def clause_not(docs: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return docs.join(other, on, "left_anti")


def clause_exists(docs: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return docs.join(other, on, "left_semi")


def around(date: Column, centre: Column, days: int = 3) -> Column:
    """Whether a date lies in the band of ``days`` before and after ``centre``."""
    return date.between(F.date_sub(centre, days), F.date_add(centre, days))


def triples(docs: DataFrame, id_: str = "id", doc: str = "doc") -> DataFrame:
    """``(id, attr, value)`` of VARIANT documents; arrays give one row per element."""
    pairs = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col(doc).outer()))
    return pairs.select(
        F.col(id_).alias("id"), F.col("key").alias("attr"),
        F.explode(one_or_many(F.col("value"))).alias("value"))
