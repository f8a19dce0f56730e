import itertools
import random

import pytest

from tidemark.llm import licenses as op
from tidemark.llm.common import alnum_words
from tidemark.llm.queries import QUERIES


def words(text):
    return alnum_words(text.encode() if text else None)


def slow_phrases(text):
    ws, out = words(text), []
    for p, label in op.PHRASES.items():
        k = words(p)
        out += [(i, label) for i in range(len(ws) - len(k) + 1) if ws[i:i + len(k)] == k]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rnd = random.Random(seed)
    sequences = [[rnd.choice("abc") for _ in range(rnd.randint(1, 12))] for _ in range(4)]
    a = op.SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i, j in itertools.combinations(range(len(s) + 1), 2)}
    text, state, length = [rnd.choice("abcd") for _ in range(200)], 0, 0
    for i, w in enumerate(text):
        state, length = a.step(state, length, w)
        want = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in runs), default=0)
        assert length == want and a.length[a.link[state]] < length <= a.length[state] if want else state == 0


NOTICE = op.TEMPLATES[1][1]
CASES = [None, "", "!!", "Released under the MIT License.", "CC BY 4.0, cc-by", "cc  BY", "GNU General Public License v3; all rights\nreserved",
         "prose " * 50 + NOTICE + " prose" * 20000, NOTICE.replace("free of charge", "at no cost").replace("merge, ", ""),
         "general public general public license license", "all rights reserved " * 3, "the license of this software is free", NOTICE + " " + NOTICE]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_phrases_match_brute_force(case):
    assert sorted(op.Scanner().scan(words(CASES[case]))[0]) == slow_phrases(CASES[case])


@pytest.mark.parametrize("seed", range(4))
def test_phrases_in_random_words(seed):
    rnd = random.Random(seed)
    text = " ".join(rnd.choice("all rights reserved cc by general public license the mit licensed under".split()) for _ in range(3000))
    assert sorted(op.Scanner().scan(words(text))[0]) == slow_phrases(text)


def test_spans():
    scan = op.Scanner().scan
    assert scan(words(CASES[3]))[1] == [(0, 4, "mit", 1.0)]
    first, last, label, covered = scan(words(CASES[7]))[1][0]
    assert (first, label, covered) == (50, "mit", 1.0) and last - first + 1 == len(words(NOTICE))
    assert [x[2] for x in scan(words(CASES[8]))[1]] == ["mit"] and 0.8 < scan(words(CASES[8]))[1][0][3] < 1
    assert scan(words(CASES[11]))[1] == []
    assert [x[:3] for x in scan(words(CASES[12]))[1]] == [(0, len(words(NOTICE)) - 1, "mit"),
                                                          (len(words(NOTICE)), 2 * len(words(NOTICE)) - 1, "mit")]
    apache = scan(words("x Licensed under the Apache License, Version 2.0. y"))[1]
    assert apache[0] == (1, 8, "apache-2.0", 1.0)


def test_rows_columns_and_ties(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(CASES)] * 2, "doc_id long, text string, score int, labels string")
    rows = op.scan_licenses(docs).collect()
    assert len(rows) == 2 * len(CASES)
    for r in rows:
        assert sorted((p.first, p.label) for p in r.licenses.phrases) == slow_phrases(r.text)
        assert r.licenses.n_words == len(words(r.text)) and 0 <= r.licenses.score <= 1 and r.score == 1
    assert op.scan_licenses(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_licenses"][0](spark, sf).collect()
    assert len(rows) == len(docs) and any(r.labels for r in rows)
    for r in rows:
        found = slow_phrases(docs[r.doc_id])
        assert (r.n_base, r.first_word, r.last_word) == (len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
