"""Every ready query against its SQL on the smallest tables."""

from __future__ import annotations

import re

import pytest
from compare import connect, kind, rows_of
from conftest import SF

from newsmart.plans import ORACLES, QUERIES


PYTHON = {"enrich_batches", "strip_noise", "page_extract_clean", "lead_image", "rate_limit", "discovery_limit"}


def check_plan(name, df):
    """No nested loops; Python workers only where named, and never row by row."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "BatchEvalPython" not in text
    if name not in PYTHON:
        assert not re.search(r"ArrowEvalPython|MapInPandas|FlatMapGroups", text)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    check_plan(name, df)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    ref = duck.execute(ORACLES[name])
    columns = [d[0] for d in ref.description]
    assert sorted(columns) == sorted(df.columns)
    types = {d[0]: kind(str(d[1])) for d in ref.description}
    assert {c: kind(t) for c, t in df.dtypes} == types
    assert rows_of(df.columns, rows) == rows_of(columns, ref.fetchall())


def test_entry_returns_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())




def test_sorted_results_come_sorted(spark):
    days = [r["day"] for r in QUERIES["timeline"](spark, SF).collect()]
    assert days == sorted(days)
    terms = [(r["search_term"].lower(), r["execution_id"]) for r in QUERIES["history_sorted"](spark, SF).collect()]
    assert terms == sorted(terms, key=lambda t: ([-ord(c) for c in t[0]] + [1], t[1]))
    pages = [r["pos"] for r in QUERIES["page"](spark, SF).collect()]
    assert pages == sorted(pages, reverse=True)
