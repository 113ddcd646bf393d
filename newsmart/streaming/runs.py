"""Incremental twins of the batch operators. Each ends in the state its batch twin computes.

Sinks go by the micro-batch number: a batch that is repeated after a failure overwrites what its first
try left, so every row counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.operators import enrich as E
from newsmart.operators.analytics import value_counts
from newsmart.operators.ranking import group_position
from newsmart.sources.versions import new_folder, written_once
from newsmart.streaming.state import BUCKETS, StateTable

__all__ = ["new_folder"]


def file_stream(
    spark: SparkSession, folder: str, schema, files_per_batch: int | None = None, only: str | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return reader.parquet(folder)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Handles all data that is there now, batch by batch, and stops. Returns the number of rows that came too late for
    their group's watermark and were left out."""
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def batch_folder(base: str, number: int) -> str:
    return f"{base}/batch={number:012d}"


def keep_state(stream: DataFrame, base: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Merges the changed groups of every micro-batch of an aggregation into a table of one row a group. Returns the number
    of late rows, as ``drain`` does."""
    spark, schema = stream.sparkSession, stream.schema
    state = StateTable(spark, f"{base}/state", keys, schema, buckets)
    return drain(stream, lambda df, n: state.merge(df, n), f"{base}/checkpoint", "update")


def kept_state(spark: SparkSession, base: str, keys: list[str], schema) -> DataFrame:
    """The table as the last whole micro-batch left it."""
    return StateTable(spark, f"{base}/state", keys, schema).read()


def running_counts(articles: DataFrame) -> DataFrame:
    """Streaming (kind, value, n) counts behind KPIs, top lists and facets."""
    return value_counts(articles)


def unique_arrivals(articles: DataFrame, keys: list[str], arrival: str, lateness: str = "30 days") -> DataFrame:
    """First arrival per key. The watermark bounds the remembered keys: a repeat is recognised within
    ``lateness`` of the first arrival."""
    return articles.withWatermark(arrival, lateness).dropDuplicatesWithinWatermark(keys)


def latest_progress(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("progress_pct", "current_step"), F.struct("ts", "event_id"))
    return events.groupBy("run_id").agg(last.alias("_l")).select("run_id", "_l.*")


def daily_counts(events: DataFrame, at: str = "ts", lateness: str = "60 days") -> DataFrame:
    """Rows per UTC day; days older than the watermark are final and leave the state."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.date_format("_w.start", "yyyy-MM-dd").alias("day"), "n")


def append_files(stream: DataFrame, base: str) -> str:
    """Exactly-once Parquet output of an append stream."""
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/rows").outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{base}/rows"


def enrich_stream(
    batched: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    ask_again: Callable[[DataFrame], DataFrame],
    base: str,
    columns: list[str | Column],
    targets: DataFrame | None = None,
    passed_at: Column | None = None,
) -> None:
    """Enriches arriving batches: results go to ``metrics``, failures to ``dlq``, and one progress row an article to
    ``events``. Rows of one model batch must arrive in one file. The stream's checkpoint takes the place of looking for
    unfinished articles. ``ask`` adds raw_response and call_error to requests (``enrich.request_rows``), ``ask_again``
    retry_response and retry_error to rows of the first pass.

    The model is asked once: its answers are written under the micro-batch's number before anything reads them, and so are
    the retries'. A micro-batch that is repeated after a failure goes on from the answers that are there.

    ``events`` counts the articles of a run in the order of their batches: current (over all micro-batches so far) of target,
    the articles that ``targets`` (execution_id, target) expects for the run. How many were done before is kept in a state
    table of one row a run."""
    spark = batched.sparkSession
    done = StateTable(spark, f"{base}/done", ["execution_id"], T.StructType().add("execution_id", batched.schema["execution_id"].dataType).add("current", T.LongType()))

    def each(rows: DataFrame, number: int) -> None:
        at = lambda kind: batch_folder(f"{base}/{kind}", number)
        answered = written_once(spark, at("answers"), lambda: ask(E.request_rows(rows)))
        retried = written_once(spark, at("retries"), lambda: ask_again(E.first_pass(answered)))
        settled = E.settle(retried)
        settled.filter(F.col("outcome") != "dlq").select(*columns).write.mode("overwrite").parquet(at("metrics"))
        E.dead_letters(settled, passed_at).write.mode("overwrite").parquet(at("dlq"))
        events = written_once(spark, at("events"), lambda: article_events(settled, done.read(), targets))
        done.merge(events.groupBy("execution_id").agg(F.max("current").alias("current")), number)

    drain(batched, each, f"{base}/checkpoint")


def article_events(settled: DataFrame, done: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(execution_id, article_id, outcome, current, target) of settled articles, counted on from what is done."""
    order = [F.col("batch_no"), F.col("article_id")]
    rows = settled.select("execution_id", "article_id", "batch_no", "outcome")
    numbered = group_position(rows, ["execution_id"], order, F.lpad(F.expr("batch_no div 100000").cast("string"), 12, "0"), "_n")
    counted = numbered.join(done.withColumnRenamed("current", "_done"), "execution_id", "left")
    counted = counted.withColumn("current", (F.col("_n") + F.coalesce("_done", F.lit(0))).cast("long"))
    if targets is None:
        return counted.select("execution_id", "article_id", "outcome", "current", F.lit(None).cast("long").alias("target"))
    expected = targets.select("execution_id", F.col("target").cast("long").alias("target"))
    return counted.join(expected, "execution_id", "left").select("execution_id", "article_id", "outcome", "current", "target")
