"""The stages one after the other: each decision takes effect, and clean documents stay."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from llm_fixtures import DIR, edge_docs, edge_rows, no_docs  # noqa: F401

from newsmart.sources.versions import durable


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES[:-1]:
        out = durable(stage(spark, seen[-1], DIR))
        assert out.columns == docs.columns, name
        seen.append(out)
    toxic, lines, near, mixed = ({(r.doc_id, r.text) for r in d.collect()} for d in seen[1:])
    ids = lambda rows: {i for i, _ in rows}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in ids(toxic)) >= 0.97 * sum(x == 0 for x in labels.values())
    assert ids(lines) == ids(toxic) and ids(near) <= ids(lines) and ids(mixed) <= ids(near)
    assert len({t for _, t in near}) == len(near) and len([t for _, t in near if not (t or "").split()]) <= 1
    times = max(seen[-1].groupBy("doc_id").count().collect(), key=lambda r: r["count"])["count"]
    assert times <= 3
    packed = P.packing(spark, seen[-1], DIR).collect()
    assert sum(r.n_words for r in packed) == sum(len((r.text or "").encode().split()) for r in seen[-1].collect())


def shingles(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_no_documents_give_no_rows(spark, no_docs):
    for name, stage in P.STAGES:
        out = stage(spark, no_docs, DIR)
        assert out.count() == 0 and (name == "packing" or out.columns == list(P.COLUMNS))


def test_edges(spark, edge_docs):
    """Null and empty texts, a null id, a repeated row and clashing columns, one stage at a time."""
    stages, given = dict(P.STAGES), [(r.doc_id, r.text) for r in edge_docs.collect()]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    clean = rows(stages["toxicity"](spark, edge_docs, DIR))
    assert clean and not Counter(clean) - Counter(given)
    lines = stages["line_dedup"](spark, edge_docs, DIR)
    assert lines.columns == list(P.COLUMNS) and Counter(i for i, _ in rows(lines)) == Counter(i for i, _ in given)
    kept_lines = dict(rows(lines))
    assert kept_lines[0] == dict(given)[0] and kept_lines[1] == "" and kept_lines[3] is None and kept_lines[9].count("\n") == 0
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())
    near = rows(stages["near_dedup"](spark, edge_docs, DIR))
    assert not any(alike(a, b) for k, (_, a) in enumerate(near) for _, b in near[:k])
    assert all(any(alike(text, other) for _, other in near) for _, text in given)
    assert {i for i, _ in near} >= {0, 3, 6, 9, 10} and None not in {i for i, _ in near}
    mixed = Counter(rows(stages["mixing"](spark, edge_docs, DIR)))
    assert mixed and set(mixed) <= set(given) and max(mixed.values()) <= 3
    packed = stages["packing"](spark, edge_docs, DIR).collect()
    assert sum(r.n_words for r in packed) == sum(len((t or "").encode().split()) for _, t in given)


def test_near_dedup_goes_by_fingerprints(spark):
    """Texts of one passage many times over with other ends have one fingerprint, whatever the share of their distinct shingles."""
    text = lambda end: " ".join(["a b c d e f g"] * 40 + [f"{end}{i}" for i in range(20)])
    texts = [text("x"), text("y"), "other words", text("z"), "other words here that are their own"]
    assert not alike(texts[0], texts[1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, DIR).collect()) == [0, 2, 4]
