"""Periodic runs against all periods of all stretches, and against SQL."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from llm_fixtures import DIR, edge_docs, edge_rows, no_docs, sql  # noqa: F401

from newsmart.llm import periods as P


def plain_runs(words, shortest=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(shortest, 2 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def split(text):
    return (text or "").encode().split()


def test_cover_meets_every_difference():
    assert {(a - b) % P.SPACING for a in P.COVER for b in P.COVER} == set(range(P.SPACING))


@pytest.mark.parametrize("pairs", [40, P.PAIRS])
def test_runs_of_random_texts(monkeypatch, pairs):
    monkeypatch.setattr(P, "PAIRS", pairs)
    rng = np.random.default_rng(pairs)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 220))
            t = rng.integers(0, rng.integers(1, 5), n)
            if n > 20:
                p, s = int(rng.integers(1, n // 2)), int(rng.integers(0, n // 2))
                for i in range(s + p, n):
                    t[i] = t[i - p]
                t[rng.integers(0, n)] = 9
            texts.append(t)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        text, *run = P.find_runs(np.concatenate(texts).astype(np.int64), first)
        for k, t in enumerate(texts):
            assert list(zip(*(c[text == k].tolist() for c in run), strict=True)) == plain_runs(t.tolist())


def test_blocks_that_hash_alike_are_told_apart(monkeypatch):
    real = np.unique
    monkeypatch.setattr(P.np, "unique", lambda a, **k: real(a & np.uint64(1) if a.dtype == np.uint64 else a, **k))
    x = np.tile(np.arange(50), 8)
    assert [c.tolist() for c in P.find_runs(x, np.array([0, len(x)]))] == [[0], [0], [400], [50]]


def test_edges(spark, edge_docs, no_docs):  # noqa: F811
    rows = P.periodic_runs(edge_docs.withColumnRenamed("key", "runs"), "doc_id", "runs", "text").collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "text", "n_words", "runs", "collapsed"}
    for r in rows:
        words = split(r.text)
        runs = plain_runs(words) if len(words) < 3000 else [tuple(x) for x in r.runs]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        assert split(r.collapsed) == plain_kept(words, runs)
    assert len(rows) == edge_docs.count() and P.periodic_runs(no_docs, "doc_id").count() == 0
    long = spark.createDataFrame([(1, "x " * 30_000 + "é " * 7), (2, "a" * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in P.periodic_runs(long, "doc_id").collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 30_000, 1)] and found[1].collapsed == "x " + "é " * 6 + "é"
    assert found[2].runs == [] and found[2].n_words == 1


def test_query(spark, sql):  # noqa: F811
    got = {r.doc_id: r for r in P.op11_periodic_runs(spark, DIR).collect()}
    ref = sql.execute(P.OP11_SQL)
    names = [d[0] for d in ref.description]
    assert {r[names.index("doc_id")]: r for r in ref.fetchall()} == {i: tuple(r[n] for n in names) for i, r in got.items()}
    changed = 0
    for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("length(text) < 4000").collect():
        words = split(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        o = got[r.doc_id]
        assert (o.n_runs, o.start, o.length, o.period) == (len(runs), *best)
        assert o.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert o.collapsed_sha256 == hashlib.sha256(b" ".join(plain_kept(words, runs))).hexdigest()
    assert changed
