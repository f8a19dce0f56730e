import collections
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decision_list, rule_ensemble, statistics as st
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "l1\nl1\n\nl2\n l1\n", "#$% &|<> ***", "É é\x0bz z",
         "a b c d e f g h q a b c d e f g h r b c d e f g h q", "word " * 20000]


def slow(text):
    text = text or ""
    words = [w for w in re.split(r"[ \x09-\x0d]+", text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^ \x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "s"), (3, "one", 1, "s")],
                                 "doc_id long, text string, n_words int, stats string")


def test_counts(docs):
    rows = st.measure(docs, "text", ["doc_id", "text"]).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert tuple(r.stats[c] for c in st.COUNTS) == slow(r.text), r.doc_id
        assert all(r.stats[c] is not None and r.stats[c] >= 0 for c in st.RATES)


def test_counts_of_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_quality_rules"][0](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = slow(docs[r.doc_id])
        assert tuple(r[c] for c in st.COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_tree_rules():
    text = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 0 <= 1.0E-4)
      Predict: 1.0
     Else (feature 0 > 1.0E-4)
      Predict: 0.0
    Else (feature 2 > 0.5)
     Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""
    assert rule_ensemble.tree_rules(text) == {
        ((2, False, 0.5),), ((2, True, 0.5),), ((0, False, 1e-4), (2, False, 0.5)), ((0, True, 1e-4), (2, False, 0.5))}


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (3, 0), (3, 1), (None, 0), (4, None), (99, 0)]])
def test_few_labels(spark, docs, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    scored = rule_ensemble.classify(docs, table).collect()
    assert len(scored) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in scored)
    assert decision_list.judge(docs, table).count() == len(TEXTS) + 2
    assert rule_ensemble.classify(docs.limit(0), table).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = QUERIES["op1_quality"][0](spark, sf)
    import zlib

    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_decision_list_on_unseen_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = decision_list.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter("doc_id % 3 > 0"))
    unseen = seen.join(labels.filter("doc_id % 3 = 0"), "doc_id").withColumn("base", decision_list.base_failed()).collect()
    bad, good = [r for r in unseen if not r.quality], [r for r in unseen if r.quality]
    assert max(r.rule for r in unseen) > 0
    caught = sum(r.base or r.rule > 0 for r in bad)
    assert caught >= 0.8 * len(bad) and caught > sum(r.base for r in bad)
    assert sum(r.rule > 0 for r in good) <= 0.03 * len(good)
