"""Firings from a stream of changes.

The file source never sees a file twice, so what is streamed is an append-only
log: each transaction arrives as a file, a listing job (``store.sync_ops``) being
what appends changes and deletions of mutable folders. Each micro-batch computes
its firings with the batch function and writes them to a folder of its own, which
a repeated attempt overwrites: the sink is idempotent, so a restart from the
checkpoint neither loses nor doubles a firing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import NAMESPACE, trigger_attr
from tidemark.operators.triggers import compute_firings, triggers_of
from tidemark.session import scratch

# the columns of a log that firings need
LOGGED = "id string, op string, doc variant, op_seq long, tx_id long"


def start_firings(
    changes: DataFrame,
    triggers: Callable[[SparkSession], DataFrame],
    out: str,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Run ``compute_firings`` over each micro-batch of ``changes(tx_id, op_seq, op, id)``.

    ``triggers`` is called per batch, so a batch sees the triggers of its time. A
    transaction must not be spread over batches: append it as one file. ``sink``
    additionally receives each batch's firings.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{out}/batch={batch_id}"
        compute_firings(batch, triggers(spark), **options).write.mode("overwrite").parquet(path)
        if sink is not None:
            sink(spark.read.parquet(path), batch_id)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_log_firings(
    spark: SparkSession,
    log_path: str,
    out: str,
    checkpoint: str,
    transactions_at_once: int | None = None,
    available_now: bool = True,
    namespace: str = NAMESPACE,
    **options,
) -> StreamingQuery:
    """Firings of a log's transactions as they become whole, written to ``out`` by ``tx_id``.

    What streams is the log's manifest (``store.append_ops``, ``append_log``), so a
    micro-batch has whole transactions however many files they have. Their rows are read
    from their own folders, the triggers from the log up to the last of them. A
    transaction that is appended again replaces its own firings, and so does a batch.
    Documents that ask to be ignored fire nothing.
    """
    from tidemark.operators import store as St

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        low, high = batch.agg(F.min("of_tx"), F.max("of_tx")).first()
        if low is None:
            return
        log = spark.read.schema(LOGGED).parquet(log_path)
        new = batch.select(F.col("of_tx").alias("tx_id")).distinct()
        ops = log.filter(F.col("tx_id").between(low, high)).join(new, "tx_id", "left_semi")
        ops = ops.withColumn("ignore", F.try_variant_get("doc", f"$['{trigger_attr('ignore', namespace)}']", "boolean"))
        triggers = triggers_of(log.filter(F.col("tx_id") <= high), namespace)
        fired = compute_firings(St.normalise_ops(ops), triggers, namespace=namespace, **options)
        fired.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tx_id").parquet(out)

    lines = spark.readStream.schema("of_tx long").option("recursiveFileLookup", "true")
    if transactions_at_once:
        lines = lines.option("maxFilesPerTrigger", transactions_at_once)
    writer = lines.json(St.manifest_of(log_path)).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def deduplicated(changes: DataFrame, time: str = "tx_time", delay: str = "10 minutes") -> DataFrame:
    """Drop change events delivered again within a delay."""
    return changes.withWatermark(time, delay).dropDuplicatesWithinWatermark(["tx_id", "op_seq", "id"])


def firings_of_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue's stream: events as a file stream, run to its end, then read back."""
    from tidemark.plans import inputs as I

    schema = I.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    changes = stream.select(
        I.hour_of(F.col("ts")).alias("tx_id"), F.col("event_id").alias("op_seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string")).alias("id"))
    home = scratch(spark, "firings")
    q = start_firings(changes, lambda s: I.triggers(s, sf), f"{home}/out", f"{home}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out").drop("batch")
