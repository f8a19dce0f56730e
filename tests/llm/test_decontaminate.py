import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as op
from tidemark.llm.common import alnum_words


def brute(text, items, window=10):
    words = alnum_words(text.encode()) if text else []
    hit, named = set(), set()
    for item, data in items:
        for w in op.windows_of(data.encode() if data else None, window):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    if item is not None:
                        named.add(str(item))
    return len(words), len(hit), sorted(named)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "Short item"), (3, "short item"), (None, "x y z"), (4, None), (5, "..."),
         (1, "a b c d e f g h i j k l"), (6, "a a a a a a a a a a a"), (12, "Éa one two three four five six seven eight nine ten")]
TEXTS = [None, "", "!!", "a b c d e f g h i j", "A,B;C d e f g h i j k l and a b c d e f g h i j", "a " * 40, "short  ITEM",
         "shortitem", "x y z short item x y z", "Éa one two three four five six seven eight nine", "éa one two three four five six seven eight nine",
         "b c d e f g h i j k", "word " * 30000 + "short item"]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(i, t, "e", t, i) for i, t in enumerate(TEXTS + TEXTS[3:5])],
                                 "doc_id long, text string, item_id string, items string, n_words int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_windows", [200_000, 30])
def test_matches_brute_force(tables, block_windows):
    docs, bench = tables
    got = op.find(docs, bench, block_windows=block_windows).withColumn("h", op.n_hit()).orderBy("doc_id").collect()
    for row in got:
        want = brute(row.text, ITEMS)
        assert (row.contamination.n_words, row.h, row.contamination.items) == want, row.doc_id
        spans = row.contamination.spans
        assert all(a.last + 1 < b.first for a, b in zip(spans, spans[1:]))


def test_clean_keeps_rows_and_columns(tables):
    docs, bench = tables
    kept = op.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(TEXTS + TEXTS[3:5]) if not brute(t, ITEMS)[1]]


def test_empty_tables(tables):
    docs, bench = tables
    assert op.find(docs.limit(0), bench).count() == 0
    assert op.find(docs, bench.limit(0)).filter(F.size("contamination.spans") > 0).count() == 0


def test_shift_skips():
    s = op.WuManber({tuple(b"abcdefghij"[i:i + 1] for i in range(10)): ["1"]}, 10)
    assert s.skip == 9 and list(s.search([b"q"] * 50)) == []


def test_blocks_are_bounded(spark):
    long = " ".join(f"w{k}" for k in range(500))
    rows = [("same", "one two three four five six seven eight nine ten eleven")] * 300 + [("long", long), (None, "x y z")] + [
        (str(k), f"short item {k}") for k in range(50)]
    items = spark.createDataFrame(rows, "item string, text string").select("item", F.col("text").cast("binary").alias("data"))
    parts = op._parts(items, 10, 40)
    blocks = [op._block(parts, k) for k in range(1 + parts.agg(F.max("block")).first()[0])]
    sizes = [sum(len(op.windows_of(d)) for _, d in b) for b in blocks]
    assert max(sizes) <= 40 and min(sizes) > 0
    found = [(i, w) for b in blocks for i, d in b for w in op.windows_of(d)]
    assert sorted(found, key=str) == sorted({(i, w) for i, t in rows for w in op.windows_of(t.encode())}, key=str)


@pytest.mark.parametrize("block_windows", [200_000, 30])
def test_columns_of_any_name(spark, tables, block_windows):
    _, bench = tables
    docs = spark.createDataFrame([(1, TEXTS[3], "a", "b", "c")], "doc_id long, text string, __now string, row string, found string")
    row = op.find(docs, bench, block_windows=block_windows).first()
    assert (row["__now"], row["row"], row["found"]) == ("a", "b", "c") and row.contamination.spans
