"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt to shards by a hash of their id, so a source that holds a third of all words is many
shards. Every shard receives an integer number of blocks, handed out one by one to the shard with the highest quotient
(its share of the source's target over 1, 3, 5, ...). A shard's documents are then strung together in a seeded order and
its blocks taken from the front, around again where a source is taken more than once. Shards whose share is below FINE
blocks are apportioned among each other by single words, so small sources get their share, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsmart.llm.words import with_word_count
from newsmart.operators.ranking import table_position
from newsmart.sources.versions import durable

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 512
FINE = 64
SHARD = 65_536
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, n_words) rows: all words shared by weight, sources by code point with
    null last taking the weights in turn. A target stops at ``most`` times the source's size; the excess is shared again
    until none is above. Only sums reach the driver. An empty table gives an empty result."""
    rows = sizes.groupBy("source").agg(F.sum("n_words").alias("source_size"))
    place = F.coalesce(F.substring(F.hex("source"), 1, 4), F.lit("~"))
    ranked = table_position(rows, place, [F.col("source").asc_nulls_last()], "_n")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    ranked = durable(ranked.withColumn("_w", weight.cast("double")).drop("_n"))
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    level, cap = (total or 0) / (all_weights or 1.0), F.col("source_size") * float(most)
    while True:
        above = F.col("_w") * level > cap
        held, free = ranked.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("_w")))).first()
        new = (total - (held or 0)) / free if free else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("_w") * level, cap).alias("target"))


def sainte_lague(cells: DataFrame, seats: int, votes: str = "votes") -> DataFrame:
    """The rows with ``seats``: the number of quotients votes / (1, 3, 5, ...) of each row among the highest ``seats`` of
    all; ties by the order of all other columns. Starts from rounded shares, which are off by no more than half the number
    of rows in sum, and hands out or takes back the rest by their quotients. Rows without votes get none."""
    names = [c for c in cells.columns if c != votes]
    votes_sum = cells.agg(F.sum(votes)).first()[0] or 0.0
    if not votes_sum or not seats:
        return cells.withColumn("seats", F.lit(0).cast("long"))
    share = F.coalesce(F.col(votes), F.lit(0.0)) * (seats / votes_sum)
    first = durable(cells.withColumn("seats", F.floor(share + 0.5).cast("long")))
    off = seats - int(first.agg(F.sum("seats")).first()[0])
    if off == 0:
        return first
    reach = F.ceil(F.col(votes) * (abs(off) / votes_sum)).cast("long") + 1
    turn = F.col("seats") + F.col("_k") if off > 0 else F.col("seats") - F.col("_k") + 1
    quotients = first.filter(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), reach))).withColumn("_turn", turn).filter("_turn > 0")
    quotient = F.col(votes) / (2 * F.col("_turn") - 1)
    tied = [F.col(c).asc_nulls_last() if off > 0 else F.col(c).desc_nulls_first() for c in names]
    moved = quotients.orderBy(quotient.desc() if off > 0 else quotient.asc(), *tied).limit(abs(off))
    moved = moved.groupBy(*(F.col(c).alias(f"_of_{c}") for c in names)).agg(F.count("*").alias("_moved"))
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names]
    change = F.coalesce("_moved", F.lit(0)) * (1 if off > 0 else -1)
    return first.join(moved, on, "left").select(*cells.columns, (F.col("seats") + change).alias("seats"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, begin, rest) for every row.

    taken words are whole rounds through the document's shard and what lies in the shard's last round, words ``begin`` to
    ``begin + size`` of the shard against its first ``rest``; a row is never taken more than ``most`` times. Null texts
    have size 0, null sources are one source, null ids are hashed as any other. The order within a shard depends on the id,
    the size and the seed alone, so reruns agree; equal rows may stand for each other.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = durable(with_word_count(given, "doc_id", "source"))
    targets = durable(source_targets(rows, weights, most))
    joined = rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD))
    joined = joined.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), shards))
    sized = joined.filter("n_words > 0")
    cells = sized.groupBy("source", "shard").agg(F.sum("n_words").alias("shard_size"), (F.first("target") / F.first("source_size") * F.sum("n_words")).alias("votes"))
    cells = durable(cells)

    def words(some: DataFrame, unit: int) -> DataFrame:
        total = some.agg(F.sum("votes")).first()[0] or 0
        return sainte_lague(some, round(total / unit)).withColumn("words", F.col("seats") * unit)

    wide = F.col("votes") >= FINE * block
    quotas = words(cells.filter(wide), block).unionByName(words(cells.filter(~wide), 1)).select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", F.least(F.col("words"), F.col("shard_size") * most).alias("quota")
    )
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    strung = sized.withColumn("begin", F.sum("n_words").over(order) - F.col("n_words"))
    strung = strung.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    rounds = F.floor(F.col("quota") / F.col("shard_size")).cast("long")
    strung = strung.withColumn("rest", F.col("quota") - rounds * F.col("shard_size"))
    part = F.greatest(F.lit(0), F.least(F.col("n_words"), F.col("rest") - F.col("begin")))
    names = ["doc_id", "source", F.col("n_words").alias("size"), "source_size", "target"]
    some = strung.select(*names, (rounds * F.col("n_words") + part).cast("long").alias("taken"), "begin", "rest")
    none = joined.filter("n_words = 0").select(*names, *(F.lit(0).cast("long").alias(c) for c in ("taken", "begin", "rest")))
    return some.unionByName(none)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
