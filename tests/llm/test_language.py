import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language as op

ROWS = [("en", "the house and the garden are where they have been for the years that we know"),
        ("fr", "la maison et le jardin sont là où ils ont toujours été depuis que nous les connaissons"),
        ("de", "das Haus und der Garten sind da wo sie immer gewesen sind seit wir sie kennen"), (None, "nothing")]


@pytest.fixture(scope="module")
def model(spark):
    return op.fit(spark.createDataFrame(ROWS * 20, "lang string, text string"), "text", "lang")


def test_trigrams():
    assert len(op.trigrams(None)) == len(op.trigrams(b"")) == len(op.trigrams(b"12 ,;!")) == 0
    assert np.array_equal(op.trigrams("Über, 99 ALLES".encode()), op.trigrams("über alles".encode()))


def test_texts(spark, model):
    texts = [(1, "the garden and the house"), (2, "le jardin et la maison"), (3, "der Garten und das Haus"), (4, None), (5, ""), (6, "123 !!"),
             (7, "qqxz wqkj zzxq jjqk xqzw vvkq " * 30), (8, "the house and the garden " * 9000), (None, "la maison"), (1, "the garden and the house")]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in texts], "doc_id long, text string, posterior double, host string")
    rows = op.identify(docs, model).collect()
    got = {(r.doc_id, r.text): r.language for r in rows}
    assert len(rows) == len(texts) and rows[0].host == "x"
    guess = {k[0]: v.guess for k, v in got.items()}
    assert (guess[1], guess[2], guess[3], guess[8], guess[None]) == ("en", "fr", "de", "en", "fr")
    assert [guess[k] for k in (4, 5, 6, 7)] == ["und"] * 4 and not any(got[k].accepted for k in got if k[0] in (4, 5, 6, 7))
    assert op.identify(docs.limit(0), model).count() == 0
    assert not any(r.language.accepted for r in op.identify(docs, op.Model([], np.zeros((op.BINS, 1)))).collect())


def test_evidence_moves_an_ambiguous_text(spark, model):
    rows = [("ok", "fr", "a.b.fr")] * 1 + [("la maison et le jardin", "fr", "a.b.fr")] * 200 + [("the house and the garden", "en", "c.b.uk")] * 200
    docs = spark.createDataFrame(rows, "text string, lang string, host string")
    with_all = op.identify(docs, model, declared=F.col("lang"), host=F.col("host"), suffix=op.suffix_of(F.col("host")))
    alone = op.identify(docs, model)
    p = lambda df: df.filter("text = 'ok'").first().language
    assert p(with_all).guess == "fr" and p(with_all).posterior > 0.9 > p(alone).posterior


def test_hosts_are_smoothed_towards_their_domain(spark):
    def prior(host, rows):
        read = spark.createDataFrame(rows, "host string, domain string, said string, suffix string, guess string")
        hosts = op._priors(read, ["en", "fr"])[0]
        return np.exp(hosts.filter(F.col("__host") == host).first()["__prior"])

    rows = [("a.x.org", "x.org", None, None, "fr")] * 100 + [("b.x.org", "x.org", None, None, "en")] + [("c.y.org", "y.org", None, None, "en")] * 300
    assert prior("a.x.org", rows)[1] > 0.85
    assert 0.6 < prior("b.x.org", rows)[1] < prior("a.x.org", rows)[1]
    assert prior("c.y.org", rows)[0] > 0.95


@pytest.mark.parametrize("url, want", [("https://User@Www.A.co.UK:80/x", ("www.a.co.uk", "co.uk", "uk")), ("localhost", (None, None, None)),
                                       ("http://host/x", ("host", "host", None)), (None, (None, None, None))])
def test_addresses(value, url, want):
    host = lambda c: op.host_of(c)
    assert value(lambda u: F.array(host(u), op.domain_of(host(u)), op.suffix_of(host(u))), u=url) == list(want)


def test_declared(value):
    assert value(op.declared_of, h='<HTML class="a" lang=EN-us><p lang="de">') == "en"
    assert value(op.declared_of, h="<html><p lang='de'>") is None


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    rows = op.identify(test, op.fit(train, "text", "lang")).collect()
    assert sum(r.language.guess == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.language.accepted for r in rows) >= 0.95 * len(rows)
    assert op.accepted(test).columns == docs.columns


def test_every_labelled_language_has_a_model(spark):
    import random

    names = [f"l{k:02}" for k in range(70)]
    rng, words = random.Random(1), {}
    for x in names:
        words[x] = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
    rows = [(x, " ".join(rng.choices(words[x], k=60))) for x in names for _ in range(3 if x > "l63" else 4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = op.fit(docs, "text", "lang")
    assert model.languages == names and [len(b.languages) for b in model.blocks()] == [64, 6]
    got = op.accepted(docs, host=None).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows)
    assert all(r.language.guess == r.lang for r in op.identify(docs, model).collect())


def test_blocks_change_nothing(spark, model):
    docs = spark.createDataFrame(ROWS * 20, "lang string, text string")
    one, many = op.identify(docs, model).collect(), op.identify(docs, op.fit(docs, "text", "lang", block_languages=1)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
