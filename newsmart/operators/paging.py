"""Deep pages of large sorted tables: an order directory that says in which range of rows a page lies.

The table is written once in ranges of about equal size that follow the wanted order; the directory holds how many rows
lie before each range. A page then reads the one or two ranges it falls into, however deep it lies, and its total is known
without counting.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmart.sources import versions as V

RANGE_ROWS = 100_000


def _order(names: list[list]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in names]


def write_directory(df: DataFrame, order: list[tuple[str, bool]], path: str, rows: int = RANGE_ROWS) -> None:
    """Writes ``df`` in ranges of about ``rows`` rows. order: (column, descending) pairs that tell all rows apart; nulls
    come last in descending and first in ascending columns. Range bounds are sampled by Spark."""
    spark = df.sparkSession
    keys = _order([list(o) for o in order])
    n = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(f"{path}/rows")
    back = spark.read.schema(f"{_ddl(df)}, _range INT").parquet(f"{path}/rows")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = back.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges")
    V.put_if_absent(spark, f"{path}/order.json", json.dumps({"order": [list(o) for o in order], "columns": _ddl(df)}))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def read_page(spark: SparkSession, path: str, number: int, size: int, first: int = 1) -> DataFrame:
    """One page with page_start, page_end and page_total; the page number is held inside the existing pages."""
    noted = json.loads(V.read_text(spark, f"{path}/order.json"))
    ranges = spark.read.schema("_range INT, n LONG, base LONG").parquet(f"{path}/ranges")
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()[0]
    pages = max(1, -(-total // size))
    start = min(max(number - first, 0), pages - 1) * size
    there = V.few_rows(ranges.filter((F.col("base") < start + size) & (F.col("base") + F.col("n") > start)), size + 1).sort_by("_range")
    chosen, base = there["_range"].to_pylist(), min(there["base"].to_pylist(), default=0)
    rows = spark.read.schema(f"{noted['columns']}, _range INT").parquet(f"{path}/rows").filter(F.col("_range").isin(chosen))
    return rows.orderBy(*_order(noted["order"])).offset(start - base).limit(size).drop("_range").select(
        "*",
        F.lit(start + 1).cast("long").alias("page_start"),
        F.lit(min(start + size, total)).cast("long").alias("page_end"),
        F.lit(total).cast("long").alias("page_total"),
    )
