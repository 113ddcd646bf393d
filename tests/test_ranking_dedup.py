"""Distributed positions against plain windows, and first-seen rules; one group holds most rows."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmart.operators import dedup as U
from newsmart.operators.ranking import group_position, hash_bucket, table_position


def skewed(spark, n=4000, seed=1):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(50)}", f"{rnd.getrandbits(64):016x}", i) for i in range(n)]
    return spark.createDataFrame(rows, "k STRING, h STRING, i LONG")


def test_group_position_equals_row_number(spark):
    df = skewed(spark)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("h")))
    got = group_position(want, ["k"], [F.col("h")], F.substring("h", 1, 1), "p", large=100)
    assert got.filter(F.col("w") != F.col("p")).count() == 0 and got.count() == 4000


def test_group_position_splits_the_hot_group(spark):
    df = skewed(spark)
    got = group_position(df, ["k"], [F.col("h")], F.substring("h", 1, 1), "p", large=100)
    assert got.agg(F.max("p")).first()[0] == df.filter("k = 'hot'").count()
    plain = group_position(df, ["k"], [F.col("h")], F.substring("h", 1, 1), "p")
    assert plain.select("i", "p").exceptAll(got.select("i", "p")).count() == 0


def test_table_position(spark):
    df = skewed(spark)
    got = table_position(df, hash_bucket(F.col("h"), 2), [F.col("h")], "p")
    want = df.withColumn("w", F.row_number().over(Window.orderBy(hash_bucket(F.col("h"), 2), "h")))
    assert got.join(want, "i").filter(F.col("w") != F.col("p")).count() == 0
    assert got.select("p").distinct().count() == 4000


def test_titles_and_urls(spark):
    rows = [(1, "r", "A", "u1", ""), (2, "r", "A", "u2", "R"), (3, "r", "", "u3", "R"), (4, "s", "A", "u1", None), (5, "r", "B", "u1", "")]
    df = spark.createDataFrame(rows, "pos INT, run STRING, title STRING, url STRING, real_url STRING")
    assert sorted(r.pos for r in U.dedup_title(df, ["run"], [F.col("pos")]).collect()) == [1, 4, 5]
    assert sorted(r.pos for r in U.dedup_url(df, ["run"], U.link(), [F.col("pos")]).collect()) == [1, 2, 4]
    kept = U.dedup_url_quota(df, ["run"], U.link(), [F.col("pos")], F.lit(1)).collect()
    assert sorted((r.pos, r["rank"]) for r in kept) == [(1, 1), (4, 1)]


def test_gate_is_strict(spark):
    rows = [(i, "x" * n) for i, n in enumerate((0, 200, 201))] + [(3, " " * 300), (4, None)]
    df = spark.createDataFrame(rows, "i INT, scraped_text STRING")
    assert [r.i for r in U.quality_gate(df).collect()] == [2]


def test_selection(spark):
    cache = spark.createDataFrame([("q", "a", 7), ("q", "b", 0), ("q", "c", 3), ("other", "a", 5), (None, "d", 4)], "query STRING, url STRING, ui_selected INT")
    chosen = spark.createDataFrame([("b", 1), ("a", 2)], "url STRING, rank INT")
    assert {(r.query, r.url): r.ui_selected for r in U.selection_rank(cache, chosen, "q").collect()} == {
        ("q", "a"): 2, ("q", "b"): 1, ("q", "c"): 0, ("other", "a"): 5, (None, "d"): 4}


def test_hot_group_is_cut_before_the_shuffle(spark):
    df = skewed(spark)
    plan = U.dedup_title(df.select(F.col("k").alias("run"), F.lit("t").alias("title"), "i"), ["run"], [F.col("i")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2
