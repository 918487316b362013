"""Periodic runs against a search of every period, on small texts and on the query's own documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from askgrid.llm import periodic
from askgrid.llm.periodic import find_runs, maximal_runs
from askgrid.llm.queries import op13_periodic_runs, replanted


def every_run(words, shortest=6, exponent=4):
    """(start, length, period) by trying all periods at all places."""
    out, n = [], len(words)
    for p in range(1, n // 2 + 1):
        same = [words[i] == words[i + p] for i in range(n - p)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            length = j - i + p
            if j > i and length >= max(2 * p, shortest, exponent * p) and not any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out)


def collapsed(words, runs):
    gone = {x for s, n, p in runs for x in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("exponent, shortest", [(2, 1), (3, 1), (4, 6)])
def test_runs_of_random_words(exponent, shortest):
    rng = random.Random(exponent)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 7)):
            n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 8])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 9)
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            docs.append(words)
        got = maximal_runs(np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs]), shortest, exponent)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in every_run(d, shortest, exponent)]


def test_a_long_text_of_one_word_and_of_fibonacci_words():
    assert maximal_runs(np.zeros(100_000, np.int64), np.array([100_000])).tolist() == [[0, 0, 100_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r[1:]) for r in maximal_runs(np.array(b), np.array([len(b)]), 1, 2).tolist()] == every_run(b, 1, 2)


def test_find_runs_on_odd_rows(spark, odd, none, monkeypatch):
    twice = odd.withColumn("runs", odd.n).withColumn("collapsed", odd.n)
    got = find_runs(twice)
    assert got.columns == [*twice.columns, "ag_runs", "ag_collapsed"]
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = cut(r["text"])
        assert [tuple(x) for x in r["ag_runs"]] == (wanted := [(1, 3000, 1)] if len(words) > 1000 else every_run(words))
        assert r["ag_collapsed"] == collapsed(words, wanted)
    assert find_runs(none).collect() == []
    assert find_runs(none, keep=["doc_id"]).columns == ["doc_id", "runs", "collapsed"]


def test_groups_of_documents_change_nothing(docs, monkeypatch):
    whole = {(r["doc_id"], tuple(r["runs"]), r["collapsed"]) for r in find_runs(docs.limit(60), keep=["doc_id"]).collect()}
    monkeypatch.setattr(periodic, "WORDS", 100)
    assert {(r["doc_id"], tuple(r["runs"]), r["collapsed"]) for r in find_runs(docs.limit(60), keep=["doc_id"]).collect()} == whole


def repeated(doc_id, text):
    """The query's words: a tenth of all documents repeat theirs."""
    words, h = cut(text), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_replanted_words(spark, docs):
    rows = {r["doc_id"]: cut(r["text"]) for r in replanted(docs).collect()}
    assert all(rows[r["doc_id"]] == repeated(r["doc_id"], r["text"]) for r in docs.collect())
    odd = spark.createDataFrame([(None, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert replanted(odd).collect() == odd.collect()


def test_query_against_all_periods(spark, sf, docs):
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, sf).collect()}
    held = found = 0
    for r in docs.collect():
        words = repeated(r["doc_id"], r["text"])
        if len(words) > 700:
            continue
        runs, own = every_run(words), got[r["doc_id"]]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert tuple(own)[1:] == (
            len(runs),
            *(best or (None, None, None)),
            best and 1000 * best[1] // best[2],
            hashlib.sha256(told.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        )
        held, found = held + 1, found + bool(runs)
    assert held > 150 and found > 10 and len(got) == docs.count()
