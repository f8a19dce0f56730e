"""Repair of conversations whose turns do not follow a lawful order of roles.

A repaired conversation reads, by the initials of its roles, ``(s?(ua)+)?``. Its rows are
edited at a cost: keep 0, give another role 3, delete 4 (the only way with blank and
repeated rows), insert an empty message 3; a truncated row that is not deleted costs 3 more.
The cheapest edits are a shortest path through the *edit lattice*, whose nodes are (rows
done, state of the order of roles). It is found from both ends: a forward and a reverse
heap take turns until their least costs together exceed the best crossing, so that every
crossing of equal cost is seen; of these the least audit (the edits' initials in order) is
taken. Audits of equal cost between the same two nodes are never one the beginning of the
other (they hold a letter for every row, and more insertions cost more), so that least
audits stay least when joined.

Rows go by turn (null first), then role, then text, so that equal rows are neighbours.
Null roles and texts are one space; a role without an initial is never kept. The fault
of a row is the first of blank, duplicate (same role and text before), truncated.

Conversations of up to ``ROWS`` rows and ``BYTES`` bytes are handled whole by one task.
A larger one is dealt out by ranges of its own order and cut into segments of ``ROWS``
rows. A segment is solved between all states at its ends, the solutions are joined in a
tree, and only SHA-256, which no two tasks can share, reads its repaired text in one
stream. Null is a conversation id like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import bounded_batches
from tidemark.operators.skew import join_keys
from tidemark.session import cut

ROWS = 512
BYTES = 16 << 20
# Segments joined by one step of the tree.
FAN = 32
WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# What may follow: nothing yet, after s, after u, after a finished pair.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
LAWFUL = ("su", "ua", "au")
REPORT = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


# ----------------------------------------------------------------- the lattice


@lru_cache(maxsize=256)
def steps(state: int, initial: str, fault: str) -> tuple[tuple[int, str, int], ...]:
    """Edits of a row in ``state``: cost, letter, state after it."""
    out = [(DELETE, "D", state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        out.append((REROLE + more, "R", NEXT[state, WANTED[state]]))
        if (state, initial) in NEXT:
            out.append((more, "K", NEXT[state, initial]))
    return tuple(out)


def shortest(rows: tuple[tuple[str, str], ...], entry: int, exits: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Cost, audit and exit state of the cheapest edits of ``rows`` (initial, fault) from ``entry`` to one of ``exits``."""
    found = [between(rows, entry, exit_) for exit_ in exits]
    return min(((*f, x) for f, x in zip(found, exits) if f), default=None)


def between(rows: tuple[tuple[str, str], ...], entry: int, exit_: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits that lead from state ``entry`` to state ``exit_``."""
    n = len(rows)

    def ahead(at, state):
        yield INSERT, "I", (at, NEXT[state, WANTED[state]])
        if at < n:
            for cost, letter, to in steps(state, *rows[at]):
                yield cost, letter, (at + 1, to)

    def behind(at, state):
        for before in range(4):
            if NEXT[before, WANTED[before]] == state:
                yield INSERT, "I", (at, before)
            if at:
                for cost, letter, to in steps(before, *rows[at - 1]):
                    if to == state:
                        yield cost, letter, (at - 1, before)

    # cost and least audit of open and of settled nodes, from the start and from the end
    start, end = (0, entry), (n, exit_)
    open_, done = ({start: (0, "")}, {end: (0, "")}), ({}, {})
    # among equal costs the rows go in order, as only kept rows cost nothing: a settled audit is final
    heaps = ([(0, 0, start)], [(0, -n, end)])
    best = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, node = heapq.heappop(heaps[side])
        if node in done[side] or open_[side][node][0] < cost:
            continue
        audit = open_[side][node][1]
        done[side][node] = cost, audit
        if node in done[1 - side]:
            other = done[1 - side][node]
            best = _less(best, (cost + other[0], audit + other[1] if side == 0 else other[1] + audit))
        for more, letter, to in (ahead if side == 0 else behind)(*node):
            total = cost + more
            grown = audit + letter if side == 0 else letter + audit
            if to in done[1 - side]:
                other = done[1 - side][to]
                best = _less(best, (total + other[0], grown + other[1] if side == 0 else other[1] + grown))
            if to not in done[side] and (to not in open_[side] or (total, grown) < open_[side][to]):
                open_[side][to] = total, grown
                heapq.heappush(heaps[side], (total, to[0] if side == 0 else -to[0], to))
    return best


def _less(a, b):
    return b if a is None or b < a else a


@lru_cache(maxsize=10_000)
def repaired(rows: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return shortest(rows, 0, FINAL)[:2]


def messages_of(audit: str, rows: Iterator[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The messages (role, text) that the edits make of ``rows``."""
    for letter in audit:
        role, text = (ROLE[WANTED[state]], "") if letter == "I" else next(rows)
        if letter == "R":
            role = ROLE[WANTED[state]]
        if letter != "D":
            state = NEXT[state, role[:1]]
            yield role, text


# -------------------------------------------------------------- whole conversations


def fault_of(role: str, text: str, seen: set[bytes]) -> str:
    key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    before, bare = key in seen, text.rstrip(WHITE)
    seen.add(key)
    return "blank" if not bare else "duplicate" if before else "truncated" if bare[-1] not in ".!?" else ""


def _report(conv_id, rows: list[tuple]) -> tuple[dict, list[tuple[str, str]]]:
    """Of the rows (turn, role, text) of one conversation in order: its report, and its messages after repair."""
    seen: set[bytes] = set()
    faults = [fault_of(role, text, seen) for _, role, text in rows]
    turns, initials = {t for t, _, _ in rows if t is not None}, [role[:1] for _, role, _ in rows]
    cost, audit = repaired(tuple(zip(initials, faults)))
    messages = list(messages_of(audit, ((role, text) for _, role, text in rows)))
    return {"conv_id": conv_id, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LAWFUL for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()}, messages


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in batches)


def _batches(rows: Iterator[dict], schema: pa.Schema, many: int = 4096, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
        if len(held) >= many or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "{id}": id_type}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def _whole(rows: DataFrame, messages: bool) -> DataFrame:
    """Conversations handled by one task each; rows that are not ``present`` only name their conversation."""
    schema = "conv_id {id}, place long, role string, text string" if messages else REPORT
    dealt = rows.select("conv_id", "present", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def out():
            for conv_id, group in groupby(_tuples(chain([first], batches)), key=lambda r: r[0]):
                report, turns = _report(conv_id, [r[2:] for r in group if r[1]])
                if messages:
                    yield from ({"conv_id": conv_id, "place": i, "role": r, "text": t} for i, (r, t) in enumerate(turns))
                else:
                    yield report

        yield from _batches(out(), _arrow(schema, first.schema.field(0).type))

    return dealt.mapInArrow(run, schema.format(id=rows.schema["conv_id"].dataType.simpleString()))


# -------------------------------------------------------------- large conversations


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, their place in their conversation, whose rows may be in many tasks."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("__row")]
    numbered = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    dealt = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # partition number and row number within it
    dealt = cut(dealt.withColumn("__part", F.shiftright("__at", 33)).drop("__row"))
    parts = dealt.groupBy("conv_id", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("conv_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("conv_id", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return join_keys(dealt, parts, ["conv_id"], "inner", ["__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop(
        "__at", "__part", "__shift")


def _with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``initial`` and ``fault``; the first of equal rows is found by a minimum."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    keyed = rows.withColumn("__key", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    first = keyed.groupBy("conv_id", "__key").agg(F.min("pos").alias("__first"))
    fault = F.when(bare == "", "blank").when(F.col("pos") > F.col("__first"), "duplicate").when(
        ~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return join_keys(keyed, first, ["conv_id"], "inner", ["__key"]).select(
        *rows.columns, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


SOLVED = "conv_id {id}, seg long, entry long, exit long, cost long, audit string, states string"


def _segments(short: DataFrame) -> DataFrame:
    """Each segment solved between all pairs of states at its ends; ``states`` are its own exit states."""
    dealt = short.select("conv_id", F.floor(F.col("pos") / ROWS).alias("seg"), "pos", "initial", "fault")
    dealt = dealt.repartition("conv_id", "seg").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seg", "pos")

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def out():
            for (conv_id, seg), group in groupby(_tuples(chain([first], batches)), key=lambda r: r[:2]):
                rows = tuple(r[3:] for r in group)
                for entry in range(4):
                    for exit_ in range(4):
                        if solved := between(rows, entry, exit_):
                            yield {"conv_id": conv_id, "seg": seg, "entry": entry, "exit": exit_, "cost": solved[0],
                                   "audit": solved[1], "states": str(exit_)}

        yield from _batches(out(), _arrow(SOLVED, first.schema.field(0).type))

    return dealt.mapInArrow(run, SOLVED.format(id=short.schema["conv_id"].dataType.simpleString()))


def _joined(solved: DataFrame) -> DataFrame:
    """One step of the tree: up to ``FAN`` neighbouring segments become one."""
    dealt = solved.withColumn("__to", F.floor(F.col("seg") / FAN)).select(
        "conv_id", "__to", "seg", "entry", "exit", "cost", "audit", "states")
    dealt = dealt.repartition("conv_id", "__to").sortWithinPartitions(F.asc_nulls_first("conv_id"), "__to", "seg")

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def out():
            for (conv_id, to), group in groupby(_tuples(chain([first], batches)), key=lambda r: r[:2]):
                known = {(e, e): (0, "", "") for e in range(4)}
                for _, rows in groupby(group, key=lambda r: r[2]):
                    grown: dict = {}
                    for _, _, _, entry, exit_, cost, audit, states in rows:
                        for e in range(4):
                            if (e, entry) in known:
                                c, a, s = known[e, entry]
                                new = (c + cost, a + audit, s + states)
                                if (e, exit_) not in grown or new[:2] < grown[e, exit_][:2]:
                                    grown[e, exit_] = new
                    known = grown
                for (e, x), (c, a, s) in known.items():
                    yield {"conv_id": conv_id, "seg": to, "entry": e, "exit": x, "cost": c, "audit": a, "states": s}

        yield from _batches(out(), _arrow(SOLVED, first.schema.field(0).type))

    return dealt.mapInArrow(run, SOLVED.format(id=solved.schema["conv_id"].dataType.simpleString()))


def _edits(short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large conversations: cost and audit, and the edits of each segment (entry state, audit)."""
    segments = cut(_segments(short))
    tree = segments
    while (tree.agg(F.max("seg")).first()[0] or 0) > 0:
        tree = cut(_joined(tree))
    least = F.min(F.struct("cost", "audit", "states")).alias("__best")
    whole = tree.filter((F.col("entry") == 0) & F.col("exit").isin(*FINAL)).groupBy("conv_id").agg(least)
    states = F.split(F.concat(F.lit("0"), "__best.states"), "")
    chosen = whole.select("conv_id", F.posexplode(F.arrays_zip(
        F.slice(states, 1, F.size(states) - 1).alias("entry"), F.slice(states, 2, F.size(states) - 1).alias("exit"))))
    chosen = chosen.select("conv_id", F.col("pos").cast("long").alias("seg"), F.col("col.entry").cast("long").alias("entry"),
                           F.col("col.exit").cast("long").alias("exit"))
    edits = join_keys(chosen, segments.select("conv_id", "seg", "entry", "exit", "audit"), ["conv_id"], "inner", ["seg", "entry", "exit"])
    return whole.select("conv_id", "__best.cost", "__best.audit"), edits.select("conv_id", "seg", "entry", "audit")


def _edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages of large conversations by (conv_id, place): each segment's rows with its edits."""
    heads = edits.select("conv_id", "seg", F.lit(-1).cast("long").alias("pos"), F.col("entry").cast("string").alias("role"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.floor(F.col("pos") / ROWS).alias("seg"), "pos", "role", "text")
    dealt = heads.unionByName(body).repartition("conv_id", "seg").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seg", "pos")
    schema = "conv_id {id}, place long, role string, text string"

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def out():
            for (conv_id, seg), group in groupby(_tuples(chain([first], batches)), key=lambda r: r[:2]):
                _, _, _, entry, audit = next(group)
                made = messages_of(audit, ((r[3], r[4]) for r in group), int(entry))
                # a path never comes to a node of the lattice twice, and there are four at each place: places rise over segments
                yield from ({"conv_id": conv_id, "place": seg * (ROWS + 1) * 4 + i, "role": r, "text": t} for i, (r, t) in enumerate(made))

        yield from _batches(out(), _arrow(schema, first.schema.field(0).type))

    return dealt.mapInArrow(run, schema.format(id=rows.schema["conv_id"].dataType.simpleString()))


def _digests(messages: DataFrame) -> DataFrame:
    """``repaired_sha256`` of each conversation's messages, read in order as a stream."""
    schema = "conv_id {id}, repaired_sha256 string"
    dealt = messages.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place").select("conv_id", "role", "text")

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def out():
            for conv_id, group in groupby(_tuples(chain([first], batches)), key=lambda r: r[0]):
                digest, mark = hashlib.sha256(), ""
                for _, role, text in group:
                    digest.update(f"{mark}{role}:{text}".encode())
                    mark = "\n"
                yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}

        yield from _batches(out(), _arrow(schema, first.schema.field(0).type))

    return dealt.mapInArrow(run, schema.format(id=messages.schema["conv_id"].dataType.simpleString()))


def _large(rows: DataFrame, messages: bool) -> DataFrame:
    placed = cut(_with_faults(_placed(rows)))
    whole, edits = _edits(placed)
    edited = _edited(placed, edits)
    if messages:
        return edited
    # neighbours are rows and their next place, so no task needs the whole conversation
    after = placed.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("initial").alias("__next"))
    pairs = join_keys(placed.select("conv_id", "pos", "initial"), after, ["conv_id"], "inner", ["pos"])
    illegal = pairs.groupBy("conv_id").agg(F.count_if(~F.concat("initial", "__next").isin(*LAWFUL)).alias("illegal"))
    turns = placed.groupBy("conv_id", "turn").count().filter("turn is not null").groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counts = placed.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")])
    out = counts
    for part in (turns, illegal, whole, _digests(edited)):
        out = join_keys(out, part, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


# ------------------------------------------------------------------------ interface


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``present``, after faults put in by crc32 of ``conv_id:turn``; dropped rows are not present.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("__kind"))
    twice = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("__kind") != 0).alias("present"), twice.alias("__copy")).drop("__copy")


def _repair(conversations: DataFrame, messages: bool) -> DataFrame:
    bounded_batches(conversations.sparkSession)
    present: Column = F.coalesce(F.col("present"), F.lit(False)) if "present" in conversations.columns else F.lit(True)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), present.alias("present"))
    sizes = rows.filter("present").groupBy("conv_id").agg(
        F.count("*").alias("__n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("__bytes"))
    large = cut(sizes.filter((F.col("__n") > ROWS) | (F.col("__bytes") > BYTES)).select("conv_id"))
    some = not large.isEmpty()
    absent = rows.filter("not present").select("conv_id").distinct()
    absent = absent.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("present"))
    here = rows.filter("present")
    if some:
        here, absent = join_keys(here, large, ["conv_id"], "left_anti"), join_keys(absent, large, ["conv_id"], "left_anti")
    out = _whole(here.unionByName(absent), messages)
    if some:
        out = out.unionByName(_large(join_keys(rows.filter("present"), large, ["conv_id"], "left_semi").drop("present"), messages))
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Needs conv_id, turn, role and text; rows whose ``present`` (if there is such a
    column) is not true only name their conversation. Other columns are ignored.
    gaps counts missing turn numbers, illegal the neighbours whose initials are not su,
    ua or au, repaired_sha256 is of ``role:text`` lines of the repaired conversation.
    """
    return _repair(conversations, messages=False)


def messages(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (rises with the order, with gaps), role, text."""
    return _repair(conversations, messages=True)
