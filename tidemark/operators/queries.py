"""Continuous queries: which results changed, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import TX_SPAN, tx_bucket, with_previous
from tidemark.operators.skew import HOT_ROWS


def result_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that entered or left a result, as multisets: ``change`` is added or removed, ``n`` how often."""
    cols = new.columns
    counted = old.select(*cols, F.lit(-1).alias("__n")).unionByName(new.select(*cols, F.lit(1).alias("__n")))
    return (
        counted.groupBy(*cols).agg(F.sum("__n").alias("d"))
        .filter(F.col("d") != 0)
        .select(*cols, F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"),
                F.abs("d").alias("n"))
    )


def has_changed(old: DataFrame, new: DataFrame) -> bool:
    return not result_changes(old, new).isEmpty()


def entity_query_changes(
    log: DataFrame, tx: str, where: Column, shown: list[Column], span: int = TX_SPAN, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Transactions after which the result of a one-entity query differs: ``(tx_id)``.

    Such a query keeps or drops each entity by itself, so its result changes with a
    transaction exactly when some entity enters it, leaves it or shows other values.
    That makes "run every query after every transaction" one pass over the log: the
    state each transaction leaves an id in, compared with the state before.

    ``tx`` names the transaction column; ``tx_id`` orders the log. Results being
    sets, an entity id must be among the values shown.
    """
    put = F.col("op") == "put"
    state = F.when(put & where, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(shown)]))
    ends = log.groupBy("id", F.col(tx).alias("__tx")).agg(
        F.max_by(F.struct(state.alias("s")), "tx_id").alias("last")).select(
        "id", "__tx", F.col("last.s").alias("s"))
    bucket = tx_bucket(F.col("__tx"), span)
    paired = with_previous(ends, ["id"], ["__tx"], bucket, {"before": "s"}, hot_rows)
    return (
        paired.filter(~F.col("s").eqNullSafe(F.col("before")))
        .select(F.col("__tx").alias("tx_id")).distinct()
    )
