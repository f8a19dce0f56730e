"""Quality rules as a learned decision list, with DataFrame operations only.

Sequential covering, as in incremental reduced error pruning: labelled rows are dealt
into parts, and each rule is grown on all but one and pruned on that one, a different one
for each rule. A rule is a conjunction of thresholds
on statistics. It grows by the threshold with the highest information gain (FOIL)
until it covers no good row, then loses the conditions from its end that do not help
on the pruning part, and is kept if it is precise there; the rows it covers leave all
parts and the next rule is learned. A rule that is not precise is tried on another part;
after all parts the rows it covers are set aside. The list ends where no rule is left.

Spark counts; the driver only sees, per step, the counts of at most ``bins`` + 1
values per statistic. Thresholds are quantiles, so labelled rows become vectors of
small numbers that are counted once.

Rows without a label teach nothing; repeated labels of an id count as the smallest.
Without labels, or with one class only, the list is empty and everything is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import statistics as st
from tidemark.session import cut

BINS = 24
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVERED = 3
# Rows are dealt into so many parts; a rule is grown on all but one and pruned on that one.
PARTS = 3
FEATURES = [*st.RATES, "n_words"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    place: int = field(compare=False, default=0)

    def on(self, value: Column) -> Column:
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def on_bin(self) -> Column:
        """The same on the number of thresholds below the value."""
        return F.col(self.feature) > self.place if self.above else F.col(self.feature) <= self.place


Rule = tuple[Condition, ...]


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def verdict(rules: list[Rule], stats: str) -> Column:
    """Number of the first rule that fires, from 1; 0 if none does and the row is good."""
    out = None
    for k, rule in enumerate(rules, 1):
        fires = _all([c.on(F.col(f"{stats}.{c.feature}").cast("double")) for c in rule])
        out = F.when(fires, k) if out is None else out.when(fires, k)
    return F.lit(0) if out is None else out.otherwise(0)


def _gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], max_conditions: int) -> Rule:
    rule: list[Condition] = []
    total = rows.agg(F.sum(F.col("n") * F.col("bad")), F.sum(F.col("n") * (1 - F.col("bad")))).first()
    bad_now, good_now = (x or 0 for x in total)
    while bad_now and good_now and len(rule) < max_conditions:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in thresholds]))
        counts = rows.filter(_all([c.on_bin() for c in rule])).select(pairs.alias("x"), "n", "bad").groupBy("x.f", "x.bin").agg(
            F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum("n").alias("n")).collect()
        best = (0.0, None, 0, 0)
        for f, cuts in sorted(thresholds.items()):
            own = sorted((r.bin, r.bad, r.n - r.bad) for r in counts if r.f == f)
            for place, threshold in enumerate(cuts):
                low_bad = sum(b for k, b, _ in own if k <= place)
                low_good = sum(g for k, _, g in own if k <= place)
                for above, b, g in ((False, low_bad, low_good), (True, bad_now - low_bad, good_now - low_good)):
                    gain = _gain(b, g, bad_now, good_now)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, threshold, place), b, g)
        if best[1] is None:
            break
        rule.append(best[1])
        bad_now, good_now = best[2], best[3]
    return tuple(rule)


def _counts(rows: DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """(bad, good) that the first 1, 2, … conditions cover."""
    sums = []
    for k in range(1, len(rule) + 1):
        fires = _all([c.on_bin() for c in rule[:k]])
        sums += [F.sum(F.when(fires, F.col("n") * F.col("bad")).otherwise(0)), F.sum(F.when(fires, F.col("n") * (1 - F.col("bad"))).otherwise(0))]
    got = rows.agg(*sums).first()
    return [(got[2 * k] or 0, got[2 * k + 1] or 0) for k in range(len(rule))]


def learn(labelled: DataFrame, stats: str, label: str, key: str, features: list[str] = FEATURES, bins: int = BINS,
          max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION,
          min_covered: int = MIN_COVERED) -> list[Rule]:
    """Rules for bad rows from rows with a struct ``stats`` and a ``label`` that is 1 for good and 0 for bad."""
    flat = labelled.filter(F.col(label).isNotNull()).select(
        *[F.col(f"{stats}.{f}").cast("double").alias(f) for f in features],
        (F.col(label) == 0).cast("int").alias("bad"), F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part"))
    at = [k / bins for k in range(1, bins)]
    # quantiles of either class, as bad rows may be few
    found = flat.groupBy("bad").agg(*[F.percentile_approx(f, at, 1000).alias(f) for f in features]).collect()
    if len(found) < 2:
        return []
    thresholds = {f: sorted({x for row in found for x in row[f]}) for f in features}
    binned = cut(flat.select(*[sum((F.col(f) > t).cast("int") for t in thresholds[f]).alias(f) for f in features], "bad", "part")
                 .groupBy(*features, "bad", "part").agg(F.count("*").alias("n")))
    rules: list[Rule] = []
    left, turn, failed = binned, 0, 0
    while len(rules) < max_rules and turn < 3 * max_rules:
        # each rule is pruned on another part of the rows than the one before
        pruning = F.col("part") == turn % PARTS
        turn += 1
        rule = _grow(left.filter(~pruning), thresholds, max_conditions)
        if not rule:
            break
        counts = _counts(left.filter(pruning), rule)
        fair = [(b / (b + g), b, k) for k, (b, g) in enumerate(counts) if b >= min_covered and b >= min_precision * (b + g)]
        if fair:
            rules.append(rule[:max(fair)[2] + 1])
            left, failed = left.filter(~_all([c.on_bin() for c in rules[-1]])), 0
            continue
        failed += 1
        if failed == PARTS:
            # rejected however the rows were dealt: what it covers is set aside, and other rules are looked for
            left, failed = left.filter(~_all([c.on_bin() for c in rule])), 0
    return rules


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One label per id, the smallest."""
    return labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__label"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """``key``, a struct stats, and ``rule``: the number of the first learned rule that fires, or 0."""
    stats = cut(st.measure(docs, text, [key]))
    rows = stats.join(one_label(labels, key, label), F.col(key) == F.col("__key"))
    rules = learn(rows, "stats", "__label", key, **options)
    return stats.select(key, "stats", verdict(rules, "stats").alias("rule"))


def base_failed(stats: str = "stats") -> Column:
    """Fewer than twenty words, or more than three tenths of them in repeated windows."""
    n = F.col(f"{stats}.n_words")
    return (n < 20) | (100 * F.col(f"{stats}.n_repeat_words") > 30 * n)
