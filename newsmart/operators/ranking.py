"""Positions inside groups and over whole tables without one task seeing a whole group.

A plain ``row_number()`` sends each group to one task, which breaks once a single group holds a large
part of the table. Here rows of large groups are split by a *bucket* that follows the wanted order
(all rows of a lower bucket come first); each bucket is numbered on its own and shifted by the size of
the buckets before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart.sources.versions import durable

LARGE_GROUP = 1_000_000


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 1) -> DataFrame:
    """The first rows of each group. The literal bound lets Spark cut every group before the shuffle,
    so a large group arrives as at most ``most`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def numbered_first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, most: int
) -> DataFrame:
    """As first_rows, keeping the position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= most)


def group_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    out: str,
    large: int = LARGE_GROUP,
) -> DataFrame:
    """1-based position inside each group; groups above ``large`` rows are numbered bucket by bucket.

    There are at most rows/large such groups, so their list stays small next to the table; Spark
    broadcasts it only when its measured size allows. Keys must not be NULL."""
    keys = list(keys)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large).drop("_n")
    marked = df.join(big.withColumn("_big", F.lit(True)), keys, "left").withColumn(
        "_bucket", F.when(F.col("_big"), bucket.cast("string")).otherwise("")
    )
    sizes = (
        df.join(big, keys, "left_semi")
        .withColumn("_bucket", bucket.cast("string"))
        .groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = marked.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    )
    return (
        local.join(shifts, keys + ["_bucket"], "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_shift"), F.lit(0)))
        .drop("_big", "_bucket", "_local", "_shift")
    )


def table_position(df: DataFrame, bucket: Column, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position over the whole table in (bucket, order) order.

    Only the bucket sizes pass through one task, so the bucket must have few distinct values (a hash
    prefix, a minute). It has to be a function of the row alone: a retried task must see it again."""
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return (
        local.join(shifts, "_bucket")
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_bucket", "_local", "_shift")
    )


def range_position(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position over the whole table in ``order``, which should tell rows apart.

    Rows are dealt by sampled ranges of the order itself, so they spread evenly whatever the keys look like, and written
    once, so that a repeated task finds the same ranges; only the sizes of the ranges pass through one task."""
    dealt = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return table_position(dealt, F.col("_range"), order, out).drop("_range")


def hash_bucket(c: Column, digits: int = 3) -> Column:
    """Even spread of text over 16**digits buckets."""
    return F.substring(F.md5(c), 1, digits)
