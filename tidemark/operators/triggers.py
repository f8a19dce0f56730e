"""Which triggers fire for a set of changes: a table of firings.

Inputs
  ops       ``tx_id, op_seq, op, id`` (normalised puts and deletes)
  triggers  ``self_id, on_k, idx, is_vector, glob`` and, when the snapshot at each
            transaction matters, ``from_tx, to_tx``: the versions a trigger lived in

Every join is an equi-join without a hint: Spark broadcasts the trigger side when
its measured size allows, and otherwise shuffles and splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.paths import glob_parts, matches_parts
from tidemark.functions.text import out_name
from tidemark.functions.values import call_specs
from tidemark.model import FIRING_COLUMNS, FIRING_DETAILS, NAMESPACE, TRIGGER_RANK, trigger_attr
from tidemark.operators.ordered import TX_SPAN, tx_bucket, with_next
from tidemark.operators.skew import BROADCAST_KEYS, is_small

# Up to this many texts that globs start with are listed in the plan.
LISTED_STARTS = 100


def expand_specs(docs: DataFrame, kind: str, specs: Column, keep: list[str] = ()) -> DataFrame:
    """One row per trigger spec of a VARIANT trigger value, with its position."""
    vector = F.schema_of_variant(specs).startswith("ARRAY")
    rows = docs.select(
        F.col("id").alias("self_id"), *keep, vector.alias("is_vector"),
        F.posexplode(call_specs(specs)).alias("idx", "spec"))
    return rows.withColumn("on_k", F.lit(kind)).withColumn(
        "glob", F.try_variant_get("spec", "$.glob", "string"))


def triggers_of(log: DataFrame, namespace: str = NAMESPACE, span: int = TX_SPAN) -> DataFrame:
    """The triggers that documents of a log carry, each with the transactions its version lived in.

    ``log`` has ``tx_id, op, id, doc`` (VARIANT). A spec is live from its own transaction
    (``from_tx``) until the next put or delete of its document (``to_tx``, null while it is
    current). ``spec`` is the call as it is written, parameters included; ``has_call`` says
    whether there is one (a query trigger without a call only stores its results).
    Intervals come from the key columns alone; documents without triggers go no further than the scan.
    """
    kinds = [k for k in TRIGGER_RANK if k != "saved_query"]
    values = F.array(*[F.struct(
        F.lit(k).alias("on_k"), F.try_variant_get("doc", f"$['{trigger_attr(k, namespace)}']", "variant").alias("value")) for k in kinds])
    carried = log.filter(F.col("op") == "put").select("id", "tx_id", F.explode(values).alias("t")).filter(
        F.col("t.value").isNotNull() & ~F.is_variant_null("t.value"))
    specs = carried.select(
        F.col("id").alias("self_id"), F.col("tx_id").alias("from_tx"), "t.on_k",
        F.schema_of_variant("t.value").startswith("ARRAY").alias("is_vector"),
        F.posexplode(call_specs(F.col("t.value"))).alias("idx", "s"))
    times = with_next(log.select("id", "tx_id"), ["id"], ["tx_id"], tx_bucket(F.col("tx_id"), span), {"to_tx": "tx_id"})
    times = times.select(F.col("id").alias("self_id"), F.col("tx_id").alias("from_tx"), "to_tx")
    is_map = F.schema_of_variant("s").startswith("OBJECT")
    return specs.join(times, ["self_id", "from_tx"]).select(
        "self_id", "on_k", "idx", "is_vector", F.try_variant_get("s", "$.glob", "string").alias("glob"),
        F.to_json("s").alias("spec"), (~is_map | F.try_variant_get("s", "$.call", "variant").isNotNull()).alias("has_call"),
        "from_tx", "to_tx")


def on_path(on_k: Column, idx: Column, is_vector: Column, namespace: str = NAMESPACE) -> Column:
    key = F.concat(F.lit(f"{namespace}.on/"), on_k)
    return F.when(is_vector, F.concat(key, F.lit("/"), idx.cast("string"))).otherwise(key)


def _of_kinds(triggers: DataFrame, *kinds: str) -> DataFrame:
    t = triggers.filter(F.col("on_k").isin(*kinds))
    for c in ("from_tx", "to_tx"):
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("bigint"))
    return t


def _of_kind(triggers: DataFrame, kind: str) -> DataFrame:
    return _of_kinds(triggers, kind).drop("on_k")


def _live(df: DataFrame) -> DataFrame:
    """Keep triggers whose version was current at the transaction."""
    tx = F.col("tx_id")
    return df.filter(
        (F.col("from_tx").isNull() | (F.col("from_tx") <= tx))
        & (F.col("to_tx").isNull() | (F.col("to_tx") > tx)))


def _firings(df: DataFrame, kind: str, target: Column, namespace: str) -> DataFrame:
    return df.select(
        "tx_id",
        F.lit(TRIGGER_RANK[kind]).alias("rank"),
        "op_seq",
        F.lit(kind).alias("on_k"),
        "self_id",
        F.col("idx").cast("int").alias("idx"),
        on_path(F.lit(kind), F.col("idx"), F.col("is_vector"), namespace).alias("on_path"),
        target.cast("string").alias("target_id"),
        *_details(df),
    )


def _details(df: DataFrame) -> list[Column]:
    """What the caller needs to make the call, as far as the inputs say it."""
    return [F.col(c) for c in FIRING_DETAILS if c in df.columns]


def _puts(ops: DataFrame) -> DataFrame:
    return ops.filter(F.col("op") == "put").select("tx_id", "op_seq", "id")


def fire_self(ops: DataFrame, triggers: DataFrame, *kinds: str, namespace: str = NAMESPACE) -> DataFrame:
    """``modify`` and ``startup``: the changed document's own triggers. Deletes carry no document."""
    t = _of_kinds(triggers, *kinds)
    hit = _live(_puts(ops).join(t, F.col("id") == F.col("self_id")))
    rank = F.create_map(*[F.lit(x) for k in kinds for x in (k, TRIGGER_RANK[k])])
    return hit.select(
        "tx_id", rank[F.col("on_k")].alias("rank"), "op_seq", "on_k", "self_id",
        F.col("idx").cast("int").alias("idx"),
        on_path(F.col("on_k"), F.col("idx"), F.col("is_vector"), namespace).alias("on_path"),
        F.col("id").alias("target_id"), *_details(hit))


def fire_refs(
    ops: DataFrame, triggers: DataFrame, closure: DataFrame, namespace: str = NAMESPACE
) -> DataFrame:
    """``refs``: documents that reach a changed document; ``closure(seed, node)`` as ids.

    A closure with ``from_tx`` and ``to_tx`` counts for the transactions from one up to the
    other only, so that references are those after each transaction.
    """
    t = _of_kind(triggers, "refs")
    timed = "from_tx" in closure.columns
    if timed:
        closure = closure.withColumnsRenamed({"from_tx": "__since", "to_tx": "__until"})
    # the pairs shrink to trigger documents before they meet the changes
    dependents = closure.join(t, closure["node"] == t["self_id"]).drop("node")
    hit = _puts(ops).join(dependents, F.col("id") == F.col("seed"))
    if timed:
        hit = hit.filter((F.col("__since") <= F.col("tx_id")) & (F.col("tx_id") < F.col("__until"))).drop("__since", "__until")
    return _firings(_live(hit), "refs", F.col("id"), namespace)


def match_globs(ids: DataFrame, globs: DataFrame, id_: str = "id", glob: str = "glob") -> DataFrame:
    """Join ids with the globs that match them.

    An id can only match globs whose literal text before their first wildcard it starts
    with. Joining on that text makes it an equi-join whose expansion is bounded by the
    number of lengths such texts have; the glob itself then decides.
    """
    g = globs.withColumn("__glob", glob_parts(F.col(glob))).withColumn("__start", F.col("__glob.prefix"))
    first = g.select("__start").distinct().limit(LISTED_STARTS + 1).collect()
    if len(first) <= LISTED_STARTS:
        listed = F.array(*[F.lit(r[0]) for r in first]).cast("array<string>")
        starts = F.filter(listed, lambda x: F.col(id_).startswith(x))
    else:
        lengths = sorted(r[0] for r in g.select(F.length("__start")).distinct().collect() if r[0] is not None)
        starts = F.transform(
            F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(id_)),
            lambda n: F.substring(F.col(id_), F.lit(1), n))
    if is_small(globs, BROADCAST_KEYS):
        # few globs go to the ids, which are not gathered by how they start
        g = F.broadcast(g)
    i = ids.withColumn("__start", F.explode(starts))
    return i.join(g, "__start").filter(
        matches_parts(F.col(id_), F.col("__glob"))).drop("__start", "__glob")


def fire_pattern(ops: DataFrame, triggers: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """``pattern``: the changed id matches a glob; a delete fires without a target."""
    t = _of_kind(triggers, "pattern")
    hit = match_globs(ops.select("tx_id", "op_seq", "op", "id"), t)
    return _firings(_live(hit), "pattern", F.when(F.col("op") == "put", F.col("id")), namespace)


def each_with_all(left: DataFrame, spread: Column, right: DataFrame, copies: int | None = None) -> DataFrame:
    """Pair each left row with every right row: what must fire per transaction.

    A right side (trigger documents) that was counted and is small goes to the left rows,
    which are not moved. A larger one is repeated per join key, and the left side is
    hashed onto the keys, of which there are as many as the session has shuffle partitions.
    """
    if copies is None and is_small(right):
        one = F.lit(0).alias("__key")
        return left.select("*", one).join(F.broadcast(right.select("*", one)), "__key").drop("__key")
    copies = copies or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l = left.withColumn("__key", F.pmod(F.xxhash64(spread), F.lit(copies)))
    r = right.withColumn("__key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))))
    return l.join(r, "__key").drop("__key")


def transactions(ops: DataFrame) -> DataFrame:
    return ops.select("tx_id").distinct()


def fire_tx(txs: DataFrame, triggers: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """``tx``: once per transaction, no target."""
    hit = each_with_all(txs.select("tx_id"), F.col("tx_id"), _of_kind(triggers, "tx"))
    return _firings(_live(hit).withColumn("op_seq", F.lit(None).cast("bigint")), "tx", F.lit(None), namespace)


def fire_lifecycle(runs: DataFrame, triggers: DataFrame, kind: str, namespace: str = NAMESPACE) -> DataFrame:
    """``startup`` or ``shutdown`` of whole runs, ``runs(tx_id)``: the target is the document itself."""
    hit = each_with_all(runs.select("tx_id"), F.col("tx_id"), _of_kind(triggers, kind))
    return _firings(
        _live(hit).withColumn("op_seq", F.lit(None).cast("bigint")), kind, F.col("self_id"), namespace)


def fire_query(changes: DataFrame, triggers: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """``query``: ``changes(tx_id, self_id, idx)`` says after which transactions results changed.

    Only triggers with ``has_call`` fire; the others just had their results stored.
    """
    t = _of_kind(triggers, "query")
    if "has_call" in t.columns:
        t = t.filter("has_call")
    more = [c for c in ("results_hash",) if c in changes.columns]
    if more and is_small(t):
        # results of standing queries are many for each trigger: few triggers go to them
        t = F.broadcast(t)
    hit = changes.select("tx_id", "self_id", "idx", *more).join(t, ["self_id", "idx"])
    return _firings(
        _live(hit).withColumn("op_seq", F.lit(None).cast("bigint")), "query", F.lit(None), namespace)


def fire_schedule(ticks: DataFrame, triggers: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """``schedule``: one firing per tick, ``ticks(self_id, idx, tx_id, ts)``, of the version put at ``tx_id``."""
    t = _of_kind(triggers, "schedule")
    hit = ticks.select("self_id", "idx", "tx_id", "ts")
    if "from_tx" in triggers.columns:
        # a tick meets its own version only, however many its document had
        hit = hit.withColumn("from_tx", F.col("tx_id")).join(t, ["self_id", "idx", "from_tx"])
    else:
        hit = hit.join(t, ["self_id", "idx"])
    return _firings(_live(hit).withColumn("op_seq", F.lit(None).cast("bigint")), "schedule", F.lit(None), namespace)


def fire_saved_query(ops: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Puts of saved query documents; the target is the document results go to."""
    name = F.coalesce(
        out_name(F.col("id"), "query", "edn", namespace), out_name(F.col("id"), "query", "md", namespace))
    hit = _puts(ops).withColumn("__out", name).filter(F.col("__out").isNotNull())
    hit = hit.select(
        "tx_id", "op_seq", F.col("id").alias("self_id"), F.lit(0).alias("idx"), F.lit(False).alias("is_vector"),
        F.concat(F.regexp_replace("id", "[^/]*$", ""), "__out").alias("__target"))
    return _firings(hit, "saved_query", F.col("__target"), namespace)


class Registry:
    """Further trigger kinds: a name, a rank and ``fn(ops, triggers) -> firings``."""

    def __init__(self) -> None:
        self.kinds: dict[str, tuple[int, Callable[[DataFrame, DataFrame], DataFrame]]] = {}

    def register(self, kind: str, rank: int, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        if kind in TRIGGER_RANK or kind in self.kinds:
            raise ValueError(f"trigger kind {kind!r} is taken")
        self.kinds[kind] = (rank, fn)

    def fire(self, ops: DataFrame, triggers: DataFrame) -> list[DataFrame]:
        return [
            fn(ops, triggers).withColumn("on_k", F.lit(kind)).withColumn("rank", F.lit(rank)).select(FIRING_COLUMNS)
            for kind, (rank, fn) in self.kinds.items()
        ]


def compute_firings(
    ops: DataFrame,
    triggers: DataFrame,
    closure: DataFrame | None = None,
    query_changes: DataFrame | None = None,
    ticks: DataFrame | None = None,
    registry: Registry | None = None,
    namespace: str = NAMESPACE,
) -> DataFrame:
    """All firings of a batch of transactions.

    One row per (transaction, operation, trigger spec), never deduplicated: two
    changed references fire twice. ``in_order`` sorts them by closeness. With triggers
    from ``triggers_of`` a firing carries its ``spec``; query changes may bring
    ``results_hash`` and schedule ticks ``ts``.
    """
    parts = [
        fire_saved_query(ops, namespace),
        fire_self(ops, triggers, "modify", "startup", namespace=namespace),
        fire_pattern(ops, triggers, namespace),
        fire_tx(transactions(ops), triggers, namespace),
    ]
    if closure is not None:
        parts.append(fire_refs(ops, triggers, closure, namespace))
    if query_changes is not None:
        parts.append(fire_query(query_changes, triggers, namespace))
    if ticks is not None:
        parts.append(fire_schedule(ticks, triggers, namespace))
    if registry is not None:
        parts.extend(registry.fire(ops, triggers))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    details = [c for c in FIRING_DETAILS if c in out.columns]
    return out.select(*FIRING_COLUMNS, *details)


def in_order(firings: DataFrame) -> DataFrame:
    """Firing order: per transaction, closest triggers first."""
    return firings.orderBy("tx_id", "rank", "op_seq", "self_id", "idx")


def frequencies(firings: DataFrame) -> DataFrame:
    return firings.groupBy("on_k").agg(F.count("*").alias("n"))
