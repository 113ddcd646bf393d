"""What the plans must look like at scale: pushed-down scans, no nested loops, Python only where named."""

from __future__ import annotations

import re
from pathlib import Path

from conftest import SF

from newsmart.plans import QUERIES

ROOT = Path(__file__).resolve().parents[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["kpis"](spark, SF))
    read = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert any("l_orderkey" in r and "l_extendedprice" not in r for r in read)
    assert not any("text" in r for r in read)


def test_filters_reach_the_scan(spark):
    lines = plan(QUERIES["fk_audit"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_suppkey)]" in lines


def test_top_lists_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_sources5"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["jobs_list"](spark, SF))


def test_library_does_not_pull_tables_to_the_driver():
    for path in (ROOT / "newsmart").rglob("*.py"):
        code = path.read_text(encoding="utf-8")
        assert "toPandas(" not in code and "localCheckpoint" not in code and "crossJoin" not in code, path
        assert ".collect()" not in code, path
