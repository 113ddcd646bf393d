"""From raw documents to packed training sequences: each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.llm.lines import without_repeated_lines
from newsmart.llm.mixing import mix
from newsmart.llm.packing import pack
from newsmart.llm.simhash import near_texts
from newsmart.llm.toxicity import toxicity as score_toxicity
from newsmart.sources.versions import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot state the learned scores and hashes; the tests hold the stages against plain versions.
ORACLE_SQL = None


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), *COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; n_chars counts what is left."""
    out = without_repeated_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near texts stays: that with the smallest id (null: the largest). Texts are near by their
    SimHash fingerprints (two or fewer differing bits), or at a similarity of 0.8 or more (five-word shingles). Texts without
    words are one group."""
    rows = _with_key(docs)
    classes = near_texts(rows.select(F.col("_key").alias("node"), F.col("text").cast("string").alias("text")))
    both = rows.select("doc_id", "_key").join(classes, F.col("_key") == F.col("node"), "left")
    best = both.groupBy(F.coalesce("component", "_key").alias("_g")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("best")
    )
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best._key").alias("_best"))
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_best")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times: whole rounds, and once more if the middle of the
    document lies within the words that its shard's last round takes."""
    rows = _with_key(docs)
    taken = mix(rows.withColumn("_id", F.struct("doc_id", "_key")), id_col="_id")
    last = (F.col("size") > 0) & (F.col("begin") + F.col("size") / 2 <= F.col("rest"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begin")))
    rounds = F.when(F.col("size") > 0, (F.col("taken") - part) / F.col("size")).otherwise(0).cast("int")
    copies = taken.withColumn("_n", rounds + last.cast("int")).groupBy("doc_id").agg(F.sum("_n").cast("int").alias("_n")).filter("_n > 0")
    copies = copies.select(F.col("doc_id.doc_id").alias("_d"), F.col("doc_id._key").alias("_k"), "_n")
    once = rows.dropDuplicates(["doc_id", "_key"])
    both = once.join(copies, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with the bin that each is packed into."""
    return pack(docs, "doc_id", "source")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
