"""Reference graphs: cycle-safe closure, descendants, link resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.paths import ancestors
from tidemark.operators.ordered import tx_bucket, with_next, with_previous, with_running_sum
from tidemark.operators.skew import BROADCAST_ROWS, is_small
from tidemark.session import cut


# Up to so many different lengths of links are listed in the plan.
MOST_LENGTHS = 1000
# Ends of intervals of transactions that have no other end; intervals hold their start and not their end.
EVER, FOREVER = -(1 << 63), (1 << 63) - 1


def _jumps(edges: DataFrame, doublings: int, growth: int) -> DataFrame:
    """``(node, next)`` over one edge, and over up to 2, 4, … edges as long as that stays within ``growth`` times the edges."""
    # a node most edges point to must remain splittable when a join shuffles them, so they stay unpartitioned
    step = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct())
    most = growth * step.count()
    for _ in range(doublings):
        further = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("last")), "next")
        longer = cut(step.unionByName(further.select("node", F.col("last").alias("next"))).distinct())
        if longer.count() > most:
            break
        step = longer
    return step


def reverse_closure(
    seeds: DataFrame, edges: DataFrame, doublings: int = 3, growth: int = 16, compact_every: int = 8
) -> DataFrame:
    """``(seed, node)`` for every node that reaches the seed over one edge or more.

    ``seeds(seed)`` and ``edges(src, dst)``; a seed is in its own closure only when
    it lies on a cycle. Semi-naïve: each round joins only the pairs found last, with
    edges that span several hops where those are not many more than the edges, since a
    round costs a job. Each round's new pairs go to the shared checkpoint folder, and
    what was visited is the union of those parts.
    """
    step = _jumps(edges, doublings, growth)
    frontier = seeds.distinct().select("seed", F.col("seed").alias("node"))
    visited: DataFrame | None = None
    rounds = 0
    while True:
        new = frontier.join(step, "node").select("seed", F.col("next").alias("node")).distinct()
        if visited is not None:
            new = new.join(visited, ["seed", "node"], "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            return frontier if visited is None else visited
        visited = frontier if visited is None else visited.unionByName(frontier)
        rounds += 1
        if rounds % compact_every == 0:
            visited = cut(visited)


def forward_closure(seeds: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """``(seed, node)`` for every node the seed reaches over one edge or more: work grows with the seeds, not the graph."""
    return reverse_closure(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), **options)


def edges_in_time(log: DataFrame, refs: Column) -> DataFrame:
    """``(src, dst, from_tx, to_tx)``: while which transactions the newest version of a document held a reference.

    ``log`` has id, tx_id and op; ``refs`` is an array of ids that a put's document refers to
    (null: none). Versions that go on holding a reference are one interval. Nulls in the array are no references.
    """
    versions = with_next(log.select("id", "tx_id", "op", F.array_distinct(refs).alias("__refs")), ["id"], ["tx_id"],
                         tx_bucket(F.col("tx_id")), {"__to": "tx_id"})
    held = versions.filter(F.col("op") == "put").select(
        F.col("id").alias("src"), F.explode("__refs").alias("dst"), F.col("tx_id").cast("bigint").alias("from_tx"),
        F.coalesce("__to", F.lit(FOREVER)).cast("bigint").alias("to_tx")).filter("dst is not null")
    # a document's versions never overlap: an interval goes on where the one before ends
    keys, bucket = ["src", "dst"], tx_bucket(F.col("from_tx"))
    placed = with_previous(held, keys, ["from_tx"], bucket, {"__before": "to_tx"})
    starts = placed.withColumn("__new", (~F.col("__before").eqNullSafe(F.col("from_tx"))).cast("int"))
    runs = with_running_sum(starts, keys, ["from_tx"], bucket, "__new", "__run")
    return runs.groupBy(*keys, "__run").agg(F.min("from_tx").alias("from_tx"), F.max("to_tx").alias("to_tx")).drop("__run")


def _covering(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The longest intervals that the intervals of each key cover without a gap."""
    before = W.partitionBy(*keys).orderBy("from_tx", "to_tx").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("from_tx", "to_tx").rowsBetween(W.unboundedPreceding, 0)
    new = spans.withColumn("__new", F.coalesce(F.col("from_tx") > F.max("to_tx").over(before), F.lit(True)).cast("int"))
    runs = new.withColumn("__run", F.sum("__new").over(upto))
    return runs.groupBy(*keys, "__run").agg(F.min("from_tx").alias("from_tx"), F.max("to_tx").alias("to_tx")).drop("__run")


def _with_part(parts: list[tuple[int, DataFrame]], part: DataFrame, most: int) -> list[tuple[int, DataFrame]]:
    """``parts`` and one more; ``most`` of one level become one of the next, so a row is written anew a few times only."""
    parts = [*parts, (0, part)]
    while len(parts) >= most and parts[-most][0] == parts[-1][0]:
        merged = reduce(DataFrame.unionByName, [df for _, df in parts[-most:]])
        parts = [*parts[:-most], (parts[-1][0] + 1, cut(merged))]
    return parts


def closure_in_time(seeds: DataFrame, edges: DataFrame, compact_every: int = 8) -> DataFrame:
    """``(seed, node, from_tx, to_tx)``: while which transactions a seed reached a node, over one edge or more.

    ``edges(src, dst, from_tx, to_tx)`` as of ``edges_in_time``. A path holds while all its
    edges do, so intervals are intersected along paths and united over them; those of one
    pair neither overlap nor touch. Semi-naïve: a round goes on from what the one before found
    and no earlier one covers, so cycles end, and work grows with what seeds reach. What was
    visited stays in parts: a round reads of them the pairs it found, and they are united at the end.
    """
    pair = ["seed", "node"]
    step = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("__next"), F.col("from_tx").alias("__from"), F.col("to_tx").alias("__to")))
    frontier = seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(EVER).alias("from_tx"), F.lit(FOREVER).alias("to_tx"))
    parts: list[tuple[int, DataFrame]] = []
    while True:
        new = frontier.join(step, "node").select(
            "seed", F.col("__next").alias("node"), F.greatest("from_tx", "__from").alias("from_tx"), F.least("to_tx", "__to").alias("to_tx"))
        frontier = cut(_covering(new.filter("from_tx < to_tx").distinct(), pair))
        if parts and not frontier.isEmpty():
            visited = reduce(DataFrame.unionByName, [df for _, df in parts])
            known = _covering(visited.join(frontier.select(*pair), pair, "left_semi"), pair).select(
                *pair, F.col("from_tx").alias("__from"), F.col("to_tx").alias("__to"))
            same = [frontier[c] == known[c] for c in pair]
            frontier = cut(frontier.join(known, [*same, known["__from"] <= frontier["from_tx"], frontier["to_tx"] <= known["__to"]], "left_anti"))
        if frontier.isEmpty():
            break
        parts = _with_part(parts, frontier, compact_every)
    if len(parts) <= 1:
        return parts[0][1] if parts else frontier
    return cut(_covering(reduce(DataFrame.unionByName, [df for _, df in parts]), pair))


def descendants(folders: DataFrame, docs: DataFrame, folder: str = "folder", id_: str = "id") -> DataFrame:
    """``(folder, id, depth)`` of everything below each folder.

    A parent chain is written in the id, so recursion is not needed: each document
    is exploded to its ancestor folders (as many as its path is deep) and joined.
    """
    ids = docs.select(F.col(id_).alias("id"))
    up = ids.select("id", F.explode(ancestors(F.col("id"))).alias("anc"))
    hit = up.join(folders.select(F.col(folder).alias("folder")).distinct(), F.col("anc") == F.col("folder"))
    below = F.size(F.split("id", "/")) - F.size(F.split("folder", "/"))
    return hit.select("folder", "id", below.alias("depth"))


def resolve_links(
    links: DataFrame, files: DataFrame, strict: bool = False, link: str = "link", path: str = "path",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(vault, link, target)``: the shortest file of the vault whose path ends with the link.

    A link may leave out ``.md``. Ends-with ignores segment borders unless
    ``strict``. Instead of comparing every link with every file, each file is
    listed under each of its suffixes and the best file per suffix is kept
    (combined on the map side, so a suffix all files share is no hot group); the
    links are then an equi-join. When the links are few, as after a small change, they
    are sent to the files and only suffixes somebody links to are kept before the
    shuffle. Ties go to the first path in order.
    """
    p = F.col(path)
    wanted = links.select("vault", F.col(link).alias("link")).distinct()
    keys = wanted.select(
        "vault", "link", F.explode(F.array_distinct(
            F.array(F.col("link"), F.concat("link", F.lit(".md"))))).alias("suffix"))
    # a file is only listed under suffixes as long as some link is
    sizes = [r[0] for r in keys.select(F.length("suffix").alias("n")).filter("n is not null").distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(sizes) <= MOST_LENGTHS:
        starts = F.transform(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>"), lambda n: F.length(p) - n + 1)
        starts = F.filter(starts, lambda i: i >= 1)
    else:
        starts = F.sequence(F.lit(1), F.length(p) + 1)
    if strict:
        starts = F.filter(starts, lambda i: (i == 1) | (F.substring(p, i - 1, F.lit(1)) == "/"))
    suffixes = F.transform(starts, lambda i: F.substring(p, i, F.length(p)))
    listed = files.select("vault", p.alias("target"), F.explode(suffixes).alias("suffix"))
    if is_small(wanted, broadcast_rows):
        listed = listed.join(F.broadcast(keys.select("vault", "suffix").distinct()), ["vault", "suffix"], "left_semi")
    best = F.min(F.struct(F.length("target").alias("len"), "target")).alias("best")
    index = listed.groupBy("vault", "suffix").agg(best)
    return (
        keys.join(index, ["vault", "suffix"])
        .groupBy("vault", "link").agg(F.min("best").alias("best"))
        .select("vault", "link", F.col("best.target").alias("target"))
    )


def refs_of(links: DataFrame, resolved: DataFrame, id_: Column) -> DataFrame:
    """Distinct ``(src, dst)`` references from links and their resolution; dangling ones drop out."""
    return links.join(resolved, ["vault", "link"]).select("src", id_.alias("dst")).distinct()
