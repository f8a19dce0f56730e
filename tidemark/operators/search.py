"""Text search over an attribute."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut

WORD = r"[\p{L}\p{N}]"


def occurrences(text: Column, terms: list[str]) -> Column:
    """The terms a text holds as whole words, lower-cased, one entry per occurrence."""
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{WORD})({words})(?!{WORD})"), F.lit(1))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda token: token == F.lit(term)


def text_search(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Documents holding any of the terms, with ``score`` = Σ tf · ln(N / df).

    Term counts are taken inside each row, so the corpus is not shuffled. N and the
    document frequencies are single rows, used as scalar subqueries.
    """
    terms = sorted({t.lower() for t in terms})
    found = occurrences(F.col(text), terms)
    # a generator's output keeps later filters from evaluating the text again
    once = F.explode_outer(F.filter(F.array(found), lambda o: F.size(o) > 0))
    rest = [c for c in docs.columns if c != text]
    counted = docs.select(*rest, once.alias("__found"))
    hits = counted.filter(F.col("__found").isNotNull())
    for i, t in enumerate(terms):
        hits = hits.withColumn(f"__tf{i}", F.size(F.filter("__found", _equals(t))))
    # the counts are small next to the text: written once, the text is read once
    hits = cut(hits.drop("__found"))
    df = hits.agg(F.struct(*[
        F.sum((F.col(f"__tf{i}") > 0).cast("bigint")).alias(f"df{i}") for i in range(len(terms))]).alias("s"))
    n = docs.agg(F.count("*").alias("n"))
    hits = hits.withColumn("__s", df.scalar()).withColumn("__n", n.scalar())
    score = sum(
        (F.when(F.col(f"__tf{i}") > 0,
                F.col(f"__tf{i}") * F.ln(F.col("__n") / F.col(f"__s.df{i}"))).otherwise(F.lit(0.0))
         for i in range(len(terms))),
        F.lit(0.0))
    return hits.select(*rest, score.alias("score"))
