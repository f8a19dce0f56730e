"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on labelled rows; every path from a root to a node is a
conjunctive rule. Rules become 0/1 columns, a logistic regression with an L1 penalty
keeps a few of them, and the score is the logistic function of an intercept and the
weights of the rules that hold, as one Spark column expression. Trees and weights are
fitted by Spark's own distributed learners on all labelled rows that are not held out.

The inputs of a score are statistics of the text only. Null and empty texts have zero
statistics and are scored like any other. With no labels, or one class, the score is
the smoothed share of good labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import statistics as st
from tidemark.llm.decision_list import one_label
from tidemark.session import cut

TREES = 12
DEPTH = 3
PENALTY = 0.002
SEED = 7
INPUTS = [*st.RATES, "log_words"]


def inputs(stats: str) -> list[Column]:
    return [*[F.col(f"{stats}.{r}") for r in st.RATES], F.log1p(F.col(f"{stats}.n_words"))]


# (input, whether above, threshold)
Condition = tuple[int, bool, float]
BRANCH = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(description: str) -> set[tuple[Condition, ...]]:
    """The conditions on the way to every node of the trees in a model's description."""
    rules: set[tuple[Condition, ...]] = set()
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        if not (m := BRANCH.match(line)):
            continue
        indent = len(m[1])
        while path and path[-1][0] >= indent:
            path.pop()
        path.append((indent, (int(m[3]), m[4] == ">", float(m[5]))))
        rules.add(tuple(sorted({c for _, c in path})))
    return rules


def holds(rule: tuple[Condition, ...], values: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [values[k] > F.lit(t) if above else values[k] <= F.lit(t) for k, above, t in rule])


@dataclass
class Ensemble:
    intercept: float
    weights: list[tuple[float, tuple[Condition, ...]]]

    def score(self, values: list[Column]) -> Column:
        """The probability of label 1."""
        total = F.lit(self.intercept)
        for w, rule in self.weights:
            total = total + F.when(holds(rule, values), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} " + " and ".join(f"{INPUTS[k]} {'>' if up else '<='} {t:g}" for k, up, t in rule) for w, rule in self.weights]


def fit(rows: DataFrame, stats: str, label: str, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY,
        seed: int = SEED) -> Ensemble:
    """``rows`` have a struct ``stats`` and a ``label`` of 1 or 0."""
    flat = cut(rows.filter(F.col(label).isin(0, 1)).select(F.array(*inputs(stats)).alias("x"), F.col(label).cast("double").alias("label")))
    n, good = flat.agg(F.count("*"), F.sum("label")).first()
    good = good or 0.0
    if not 0 < good < n:
        import math

        return Ensemble(math.log((good + 1) / (n - good + 1)), [])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64)
    model = forest.fit(flat.select(array_to_vector("x").alias("features"), "label"))
    rules = sorted(tree_rules(model.toDebugString))
    values = [F.col("x")[k] for k in range(len(INPUTS))]
    ones = F.array(*[holds(r, values).cast("double") for r in rules])
    sparse = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    fitted = sparse.fit(cut(flat.select(ones.alias("x"), "label")).select(array_to_vector("x").alias("features"), "label"))
    weights = [(float(w), r) for w, r in zip(fitted.coefficients.toArray(), rules) if abs(w) > 1e-9]
    return Ensemble(float(fitted.intercept), weights)


def held_out(key: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """``key``, a struct stats, held_out and score of every document."""
    stats = cut(st.measure(docs, text, [key]).withColumn("held_out", held_out(key)))
    rows = stats.filter("not held_out").join(one_label(labels, key, label), F.col(key) == F.col("__key"))
    model = fit(rows, "stats", "__label", **options)
    return stats.select(key, "stats", "held_out", model.score(inputs("stats")).alias("score"))
