"""Which texts are contained in which, by an inverted index of character grams.

A text that contains another holds all its grams, so it also holds the one that is rarest among all texts searched. Only
texts that share this one gram meet, by an equality join; what meets is then compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none in shorter texts."""
    last = F.char_length(text) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def contained(needles: DataFrame, hay: DataFrame, needle: str, text: str, size: int = GRAM) -> DataFrame:
    """(needle, text) for every value of ``needle`` that is contained in a value of ``text``; empty needles are in none.

    Needles shorter than a gram are grams themselves. Work grows with the characters of both sides and with the pairs that
    share a needle's rarest gram, not with all pairs."""
    wanted = needles.select(needle).filter(F.char_length(needle) > 0).distinct()
    texts = hay.select(text).filter(F.col(text).isNotNull()).distinct()
    short = F.char_length(needle) < size
    own = wanted.select(needle, F.explode(F.when(short, F.array(needle)).otherwise(grams(F.col(needle), size))).alias("_gram"))
    every = F.flatten(F.array(*(grams(F.col(text), k) for k in range(1, size + 1))))
    index = texts.select(text, F.explode(every).alias("_gram")).join(own.select("_gram").distinct(), "_gram", "left_semi")
    often = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rated = own.join(often, "_gram", "left")
    seeds = rated.groupBy(needle).agg(F.min_by("_gram", F.coalesce("_n", F.lit(0))).alias("_gram"), F.count_if(F.col("_n").isNull()).alias("_absent"))
    met = seeds.filter("_absent = 0").join(index, "_gram")
    return met.filter(F.contains(text, needle)).select(needle, text)
