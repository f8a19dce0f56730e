"""The versioned document store: transaction log, history, snapshots, diffs.

A log is a DataFrame with ``tx_id, tx_time, op ('put' or 'delete'), id`` and any
payload columns, with at most one row per (id, tx_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import TX_SPAN, tx_bucket, with_next, with_previous
from tidemark.operators.skew import HOT_ROWS

_LOG_COLUMNS = ("tx_id", "tx_time", "op", "id", "valid_time")


def payload_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in _LOG_COLUMNS]


def log_from(log: DataFrame, tx_id: int | Column) -> DataFrame:
    """The log from a transaction on."""
    return log.filter(F.col("tx_id") >= tx_id)


def as_of(
    log: DataFrame, tx_id: int | None = None, time: Column | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Live documents as of a transaction or a time (the newest state without either).

    The newest version per id is found on the key columns alone, by a hash aggregate
    that is combined on the map side; a semi-join brings back the payload of just these
    versions. Only ``columns`` of the payload are read, all of it without.
    """
    if tx_id is not None:
        log = log.filter(F.col("tx_id") <= tx_id)
    if time is not None:
        log = log.filter(F.col("tx_time") <= time)
    rest = [c for c in log.columns if c not in ("id", "tx_id", "op", "valid_time")]
    if columns is not None:
        rest = [c for c in rest if c in columns]
    newest = log.groupBy("id").agg(F.max("tx_id").alias("tx_id"))
    # what a delete ends needs no payload, so it is dropped before the join
    live = log.filter(F.col("op") == "put").select("id", "tx_id", *rest)
    return live.join(newest, ["id", "tx_id"], "left_semi")


def entity(log: DataFrame, id_: str) -> DataFrame:
    """The current document with an id; no row when there is none."""
    return as_of(log.filter(F.col("id") == id_))


def history(log: DataFrame, span: int = TX_SPAN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every version with the interval ``[valid_from, valid_to)`` it was current in."""
    bucket = tx_bucket(F.col("tx_id"), span)
    return with_next(log, ["id"], ["tx_id"], bucket, {"valid_to": "tx_time"}, hot_rows).withColumnRenamed(
        "tx_time", "valid_from")


def valid_history(log: DataFrame, rows_per_bucket: int = 1 << 20) -> DataFrame:
    """History ordered by valid time, for logs whose versions may be written late.

    Valid times do not follow transaction ids, so the bucket is a slice of time;
    one aggregate over the log sizes it.
    """
    log = log.withColumn("valid_from", F.coalesce("valid_time", "tx_time"))
    seconds = F.unix_seconds(F.col("valid_from").cast("timestamp"))
    n, lo, hi = log.agg(F.count("*"), F.min(seconds), F.max(seconds)).first()
    width = max(1, int(((hi or 0) - (lo or 0) + 1) * rows_per_bucket / max(n, 1)))
    return with_next(
        log, ["id"], ["valid_from", "tx_id"], F.floor(seconds / F.lit(width)), {"valid_to": "valid_from"},
        rows_per_bucket)


def history_changes(
    log: DataFrame, state: Column, span: int = TX_SPAN, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Versions whose ``state`` differs from the previous version of the same id."""
    bucket = tx_bucket(F.col("tx_id"), span)
    marked = log.withColumn("__state", state).withColumn("__some", F.lit(True))
    paired = with_previous(
        marked, ["id"], ["tx_id"], bucket, {"__prev": "__state", "__had": "__some"}, hot_rows)
    changed = F.col("__had").isNull() | ~F.col("__state").eqNullSafe(F.col("__prev"))
    return paired.filter(changed).withColumn("is_first", F.col("__had").isNull()).drop(
        "__state", "__some", "__prev", "__had")


def normalise_ops(log: DataFrame) -> DataFrame:
    """The puts and deletes triggers look at.

    Drops transactions that did not commit (an unknown flag passes), operations
    at a valid time, other kinds, and documents that ask to be ignored. Optional
    columns count only when the log has them.
    """
    keep = F.col("op").isin("put", "delete")
    if "valid_time" in log.columns:
        keep = keep & F.col("valid_time").isNull()
    if "committed" in log.columns:
        keep = keep & F.coalesce("committed", F.lit(True))
    if "ignore" in log.columns:
        keep = keep & ~F.coalesce("ignore", F.lit(False))
    return log.filter(keep)


def resolve_deletes(deletes: DataFrame, log: DataFrame, key: Column) -> DataFrame:
    """Give deletes known only by ``id_hash`` the id their document had."""
    asked = deletes.select("id_hash").distinct()
    # only the puts somebody asks about are made distinct
    known = log.filter(F.col("op") == "put").select(key.alias("id_hash"), "id").join(asked, "id_hash", "left_semi").distinct()
    return deletes.join(known, "id_hash", "left")


def stale(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids whose ``(id, modified)`` differ between a listing and the store.

    ``status`` is new, changed or deleted.
    """
    a = seen.groupBy("id").agg(F.max("modified").alias("seen"))
    b = stored.groupBy("id").agg(F.max("modified").alias("stored"))
    status = (
        F.when(F.col("stored").isNull(), "new")
        .when(F.col("seen").isNull(), "deleted")
        .otherwise("changed")
    )
    return (
        a.join(b, "id", "full_outer")
        .filter(~F.col("seen").eqNullSafe(F.col("stored")))
        .select("id", "seen", "stored", status.alias("status"))
    )


def sync_ops(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """The operations one sync transaction appends: put what exists, delete what is gone."""
    return stale(seen, stored).select(
        "id", F.when(F.col("seen").isNull(), "delete").otherwise("put").alias("op"),
        F.col("seen").alias("modified"))


def manifest_of(path: str) -> str:
    """Where a log says which transactions are whole: next to its folder."""
    return f"{path.rstrip('/')}-transactions"


def append_ops(ops: DataFrame, path: str, tx_id: int, tx_time: Column) -> None:
    """Append one transaction to a parquet log.

    The transaction has a folder of its own that is overwritten as a whole, so a
    repeated attempt after a failure leaves the same rows. A line in the log's
    manifest follows once all its files are there. Without an ``op_seq`` the operations
    have no order among them and are numbered by their ids, alike in every attempt.
    """
    if "op_seq" not in ops.columns:
        ops = ops.withColumn("op_seq", F.xxhash64("id"))
    ops.withColumn("tx_time", tx_time).write.mode("overwrite").parquet(f"{path}/tx_id={tx_id}")
    line = ops.sparkSession.range(1).select(F.lit(tx_id).cast("bigint").alias("of_tx"))
    line.write.mode("overwrite").json(f"{manifest_of(path)}/tx_id={tx_id}")


def append_log(rows: DataFrame, path: str) -> None:
    """Append many transactions at once: ``rows`` have ``tx_id``, ``op_seq`` and ``tx_time``.

    Each goes to the folder that ``append_ops`` would write, however many files it
    needs, and replaces what was there; the manifest follows when all are written.
    """
    rows = rows.withColumn("of_tx", F.col("tx_id"))
    write = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tx_id")
    write(rows.drop("of_tx")).parquet(path)
    write(rows.select("tx_id", "of_tx").distinct()).json(manifest_of(path))


def upsert(docs: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Shallow merge of updates into documents; returns the new put rows.

    An update of an id that no document has is an error.
    An update holds ``id``, any of ``columns``, and ``keys``: the names it sets. A
    named key wins even when its value is null.
    """
    u = updates.select("id", "keys", *[F.col(c).alias(f"__{c}") for c in columns if c in updates.columns])
    merged = u.join(docs.withColumn("__known", F.lit(True)), "id", "left").filter(
        F.when(F.col("__known"), True).otherwise(
            F.raise_error(F.concat(F.lit("no document to update: "), F.coalesce("id", F.lit("null")))).cast("boolean")))
    return merged.select(
        "id",
        *[c for c in docs.columns if c != "id" and c not in columns],
        *[
            (F.when(F.array_contains("keys", F.lit(c)), F.col(f"__{c}")).otherwise(F.col(c))).alias(c)
            if c in updates.columns else F.col(c)
            for c in columns
        ],
    )
