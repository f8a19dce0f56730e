import itertools

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as passages_of
from tests.llm.test_simhash import groups_of, near, slow_fingerprint
from tests.llm.test_suffix_dedup import brute as repeats_of
from tidemark.llm import bpe, language

SF = "/root/testdata/sf0.001"
NAMES = ["language_id", "near_duplicates", "repeated_passages", "test_passages", "token_ids"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents after each stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(df.columns == COLUMNS for df in stages[:-1]) and stages[-1].columns[:5] == COLUMNS


def test_language(stages):
    docs, kept = stages[0], texts(stages[1])
    model = language.fit(docs, "text", "lang")
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()
    assert kept == {r.doc_id: r.text for r in found if r.language.accepted} and len(kept) >= 0.95 * len(found)


def test_near_duplicates(stages):
    before, after = texts(stages[1]), texts(stages[2])
    fps = {d: slow_fingerprint(t) for d, t in before.items()}
    groups = groups_of(sorted(before), lambda a, b: near(fps[a], fps[b]))
    assert after == {d: t for d, t in before.items() if groups[d] == d} and len(after) < len(before)


def test_repeated_passages(stages):
    before, after = texts(stages[2]), texts(stages[3])
    data = {d: t.encode() for d, t in before.items()}
    for d, spans in zip(data, repeats_of(list(data.values()), 400)):
        borders = [0, *itertools.chain(*spans), len(data[d])]
        kept = b"".join(data[d][a:b] for a, b in zip(borders[::2], borders[1::2]))
        assert after[d] == kept.decode("utf-8", "ignore")
    assert sorted(before) == sorted(after) and before != after


def test_test_passages(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    assert after == {d: t for d, t in before.items() if not passages_of(t, items)[1]}


def test_token_ids(stages):
    before, rows = texts(stages[4]), stages[5].collect()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert sorted(r.doc_id for r in rows) == sorted(before)
    for r in rows:
        ids = ref.encode_ordinary(before[r.doc_id])
        assert b"".join(i.to_bytes(4, "little") for i in ids) == bytes(r.ids) and r.n_tokens == len(ids) and r.round_trip


def test_empty_table_and_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "the house and the garden", "en", "a", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [2]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
