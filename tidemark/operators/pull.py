"""Pull: attribute subsets and nested lookups along references, forward and backward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import attr
from tidemark.operators.ordered import with_running_sum
from tidemark.operators.skew import HOT_ROWS


def pull(docs: DataFrame, attrs: dict[str, str], id_: str = "id", doc: str = "doc") -> DataFrame:
    """Typed attribute subset of VARIANT documents; a missing attribute is null."""
    return docs.select(id_, *[attr(F.col(doc), a, t).alias(a) for a, t in attrs.items()])


def pull_many(docs: DataFrame, ids: DataFrame, columns: list[str], id_: str = "id") -> DataFrame:
    """Attribute subset of the entities named in ``ids``."""
    return docs.select(id_, *columns).join(ids, id_, "left_semi")


def pull_ref(df: DataFrame, ref: str, target: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``{ref [columns]}``: columns of the referenced entity, null when it dangles."""
    right = target.select(F.col(key).alias("__k"), *[F.col(s).alias(o) for o, s in columns.items()])
    return df.join(right, df[ref] == right["__k"], "left").drop("__k")


def pull_reverse(
    parents: DataFrame, key: str, children: DataFrame, ref: str, columns: dict[str, str]
) -> DataFrame:
    """``{_ref [columns]}`` as flat rows: one per (parent, child), childless parents kept.

    The flat form has no bound on children per parent; ``numbered`` gives their positions.
    """
    right = children.select(F.col(ref).alias("__r"), *[F.col(s).alias(o) for o, s in columns.items()])
    return parents.join(right, parents[key] == right["__r"], "left").drop("__r")


def numbered(
    rows: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "pos", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Items of each key with their position, from 1, in an order that is unique within the key.

    A list of any length has the same shape: one row per item. ``bucket`` grows with the
    order, such as an id divided by a million; a key with more than ``hot_rows`` rows is
    numbered bucket by bucket, so no task ever holds all items of a hot key.
    """
    one = rows.withColumn("__one", F.lit(1).cast("bigint"))
    return with_running_sum(one, keys, order, bucket, "__one", out, hot_rows).drop("__one")
