"""Names and schemas shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

# Prefix of the reserved attributes. Files written for another prefix are read
# by passing ``namespace=`` to the functions that look at attribute names.
NAMESPACE = "tide"
SIDECAR_EXTENSION = "meta.edn"


def refs_attr(namespace: str = NAMESPACE) -> str:
    return f"{namespace}/refs"


def trigger_attr(kind: str, namespace: str = NAMESPACE) -> str:
    return f"{namespace}.on/{kind}"


# The order in which one transaction's triggers fire, closest first.
TRIGGER_RANK = {
    "saved_query": 2,
    "modify": 3,
    "refs": 4,
    "pattern": 5,
    "startup": 6,
    "query": 7,
    "tx": 8,
    "schedule": 9,
    "shutdown": 10,
}

FIRING_COLUMNS = [
    "tx_id", "rank", "op_seq", "on_k", "self_id", "idx", "on_path", "target_id",
]

# What else a firing may know: the call with its parameters, the hash of a query's results, the tick.
FIRING_DETAILS = ["spec", "results_hash", "ts"]

TX_LOG_SCHEMA = T.StructType([
    T.StructField("tx_id", T.LongType(), False),
    T.StructField("tx_time", T.TimestampType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("valid_time", T.TimestampType(), True),
    T.StructField("doc", T.VariantType(), True),
])

TRIGGER_SCHEMA = T.StructType([
    T.StructField("self_id", T.StringType(), False),
    T.StructField("on_k", T.StringType(), False),
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("is_vector", T.BooleanType(), False),
    T.StructField("glob", T.StringType(), True),
])

MESSAGE_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampType()),
    T.StructField("from", T.ArrayType(T.StringType())),
    T.StructField("to", T.ArrayType(T.StringType())),
    T.StructField("cc", T.ArrayType(T.StringType())),
    T.StructField("bcc", T.ArrayType(T.StringType())),
    T.StructField("sender", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("message-id", T.StringType()),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("in-reply-to", T.StringType()),
    T.StructField("reply-to", T.StringType()),
    T.StructField("thread-id", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])
