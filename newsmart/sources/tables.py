"""Stored tables by name: declared layouts over versioned Parquet (see ``versions.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart import schemas as S
from newsmart.sources import versions as V

LAYOUTS = {
    "search_executions": S.EXECUTIONS, "articles": S.ARTICLES, "articles_cache": S.ARTICLES_CACHE, "chat_history": S.CHAT_HISTORY,
    "dim_date": S.DIM_DATE, "dim_source": S.DIM_SOURCE, "dim_entities": S.DIM_ENTITIES, "fact_news_metrics": S.FACT_NEWS_METRICS,
    "dlq_news_metrics": S.DLQ_NEWS_METRICS, "job_progress": S.JOB_PROGRESS,
}


def layout(name: str) -> T.StructType:
    """Declared columns of a table; its name must be known."""
    if name not in LAYOUTS:
        raise KeyError(f"no layout for table {name}")
    return T.StructType.fromDDL(LAYOUTS[name])


def fitted(name: str, rows: DataFrame) -> DataFrame:
    """Rows in the layout of a table: its columns in its order and types, missing ones empty; others are refused."""
    fields = layout(name).fields
    unknown = sorted(set(rows.columns) - {f.name for f in fields})
    if unknown:
        raise ValueError(f"table {name} has no columns {', '.join(unknown)}")
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest version of a stored table, typed by its layout; empty if nothing was stored yet."""
    return V.read_latest(spark, f"{root}/{name}", layout(name))


def append_rows(root: str, name: str, rows: DataFrame) -> int:
    """Adds rows to a stored table; returns the version that holds them."""
    return V.append_table(rows.sparkSession, f"{root}/{name}", fitted(name, rows))


def merge_rows(spark: SparkSession, root: str, name: str, build) -> int:
    """Next version of a stored table = build(current rows)."""
    return V.replace_table(spark, f"{root}/{name}", lambda old: fitted(name, build(old)), layout(name))
