import collections
import math
import zlib

import pytest

from tidemark.llm import katz as op
from tidemark.llm.common import spaced_words


def tokens(text):
    return [*spaced_words((text or "").encode()), b"the end"]


def numbers(counts):
    n = [0] * (op.K + 3)
    for c in counts:
        n[min(c, op.K + 2)] += 1
    return n


def factors(n):
    for k in range(5, 0, -1):
        if all(n[r] for r in range(1, k + 2)) and (k + 1) * n[k + 1] < n[1]:
            a = (k + 1) * n[k + 1] / n[1]
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)}
            if all(0 < x <= 1 for x in d.values()):
                return d
    return {}


class Brute:
    """The model by its formulas, in dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = collections.Counter(), collections.defaultdict(collections.Counter)
        for t in map(tokens, texts):
            self.uni.update(t)
            for h, w in zip([b"the start", *t], t):
                self.bi[h][w] += 1
        self.n = sum(self.uni.values())
        du, self.d = factors(numbers(self.uni.values())), factors(numbers(c for x in self.bi.values() for c in x.values()))
        left = math.fsum((1 - du.get(c, 1)) * c for c in self.uni.values())
        over = self.n + (left < 1e-12)
        self.unseen = ((left if left >= 1e-12 else 1) / over) if self.n else 1.0
        self.p = {w: du.get(c, 1) * c / over for w, c in self.uni.items()}
        self.over, self.weight = {}, {}
        for h, x in self.bi.items():
            c, left = sum(x.values()), math.fsum((1 - self.d.get(r, 1)) * r for r in x.values())
            c, left = (c, left) if left > 1e-9 * c else (c + 1, 1)
            self.over[h], self.weight[h] = c, left / c / max(1 - math.fsum(self.p[w] for w in x), self.unseen)

    def prob(self, h, w):
        if r := self.bi[h][w] if h in self.bi else 0:
            return self.d.get(r, 1) * r / self.over[h]
        return self.weight.get(h, 1.0) * self.p.get(w, self.unseen)

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1))) for w in t)
        return len(t), sum(w in self.uni for w in t), self.n, base, sum(math.log10(self.prob(h, w)) for h, w in zip([b"the start", *t], t))


def same(row, want):
    assert tuple(row)[:3] == want[:3]
    assert tuple(row)[3:] == pytest.approx(want[3:], rel=1e-9, abs=1e-9)


TEXTS = [None, "", " \n", "a b c a b d", "A B c  a\tb e", "the cat sat on the mat", "the dog sat on the cat", "x " * 500, "unique words only here",
         "a b c a b d", "é É ß", "the the the the", *[f"word{i % 7} word{i % 5} word{i % 11} the end{i}" for i in range(60)]]


@pytest.mark.parametrize("limits", [(24 << 20, 500, 64 << 20), (100, 5, 1 << 20)])
def test_matches_brute_force(spark, monkeypatch, tmp_path, limits):
    for name, value in zip(("BUCKET_BYTES", "HOT", "SAMPLE_BYTES"), limits):
        monkeypatch.setattr(op, name, value)
    if limits[1] == 5:
        monkeypatch.setattr(op, "CHUNK", 7)
        monkeypatch.setattr(op, "WINDOW", 40)
        monkeypatch.setattr(op, "SAMPLE_BYTES", 4000)  # hot words are looked for from an eighth of it on
    monkeypatch.setattr(op, "AT_ONCE", 50)
    docs = spark.createDataFrame([(i, t, i % 4 == 1, "k") for i, t in enumerate(TEXTS)], "id long, text string, held boolean, score string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    model = op.fit(docs.filter("not held"))
    brute = Brute([t for i, t in enumerate(TEXTS) if i % 4 != 1])
    got = {r.id: r for r in op.score(docs, model).collect()}
    assert len(got) == len(TEXTS) and set(got[0].asDict()) == {"id", "held", "score", "katz"}
    if limits[1] == 5:
        assert len(model.known.routes.hot) > 2 and model.known.routes.buckets > 5
    for i, text in enumerate(TEXTS):
        same(got[i].katz, brute.score(text))


def test_probabilities_sum_to_one():
    """Of every history, over the vocabulary and the unseen words together."""
    for texts in (TEXTS, TEXTS[3:6], ["a"], ["a b", "a b", "a b"]):
        model = Brute(texts)
        for h in [*model.bi, b"never seen"]:
            total = math.fsum(model.prob(h, w) for w in model.uni) + model.prob(h, b"\x00unseen")
            assert total == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "id long, text string")
    model = op.fit(none)
    assert op.score(none, model).count() == 0
    row = op.score(spark.createDataFrame([(1, "a b")], "id long, text string"), model).first().katz
    same(row, (3, 0, 0, 0.0, 0.0))
    # one text of one word
    model = op.fit(spark.createDataFrame([(1, "a")], "id long, text string"))
    for text in ("a", "b", None):
        same(op.score(spark.createDataFrame([(1, text)], "id long, text string"), model).first().katz, Brute(["a"]).score(text))


def test_long_texts_are_split_between_words(monkeypatch):
    text = "one two  three\nfour " * 50 + "x" * 200
    whole = op.word_ids(text, op.Hashes()).tolist()
    monkeypatch.setattr(op, "PART", 30)
    monkeypatch.setattr(op, "MEMORY", 3)
    assert op.word_ids(text, op.Hashes()).tolist() == whole


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op13_katz"][0](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    brute = Brute([r.text for r in rows if not held[r.doc_id]])
    for r in rows:
        row = got[r.doc_id]
        assert row.held_out == held[r.doc_id]
        same((row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score), brute.score(r.text))
