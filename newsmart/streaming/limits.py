"""Sliding request limits.

A request is admitted when fewer than ``limit`` admitted requests of its client lie less than ``window``
seconds back; rejected requests are not remembered. Admission therefore depends on the requests before.
Kinds of requests may have limits of their own and still share what is remembered of a client: the limit is
then a column. Times are microseconds (long).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart import schemas as S
from newsmart.sources import versions as V
from newsmart.streaming.runs import batch_folder, drain

MICROS = 1_000_000


def client(forwarded: Column, remote: Column) -> Column:
    """First address of the forwarding header, else the peer address."""
    return F.trim(F.get(F.split(F.coalesce(forwarded, remote, F.lit("unknown")), ","), F.lit(0)))


def trailing_count(requests: DataFrame, key: str = "ip", window: int = S.RATE_WINDOW_SEC) -> DataFrame:
    """Adds n_recent: requests of the client less than ``window`` seconds back, this one included.

    The time line is cut into slots of one window. Every request arrives in its slot and leaves in the next, so a
    slot knows all it looks back on and even the busiest client is spread over its slots: what counts at a time is all that
    leaves in the slot, with those that have arrived and without those that have left by then. Both are running sums, so a
    slot costs its sort however many requests are in it."""
    span = window * MICROS
    slot = F.expr(f"(t - pmod(t, {span})) div {span}")
    rest = [c for c in requests.columns if c not in (key, "t")]
    step = F.explode(F.array(
        F.struct(slot.alias("slot"), F.col("t").alias("at"), F.lit(1).alias("add")),
        F.struct((slot + 1).alias("slot"), (F.col("t") + span).alias("at"), F.lit(-1).alias("add")),
    ))
    shown = requests.withColumn("_s", step).select(
        key, "_s", *(F.when(F.col("_s.add") == 1, F.col(c)).alias(c) for c in rest))
    w = Window.partitionBy(key, F.col("_s.slot")).orderBy("_s.at")
    now = F.sum("_s.add").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    leaving = F.count_if(F.col("_s.add") == -1).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        shown.withColumn("n_recent", now + leaving).filter(F.col("_s.add") == 1).withColumn("t", F.col("_s.at"))
        .select(*requests.columns, "n_recent")
    )


def _walk(span: int):
    """Admission over rows sorted by (client, stretch, t); keeps at most the largest limit's times in memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, deque()
        for frame in frames:
            admitted = []
            for key, stretch, t, limit in zip(frame["_key"], frame["_stretch"], frame["t"], frame["_limit"]):
                if (key, stretch) != current:
                    current, kept = (key, stretch), deque()
                while kept and t - kept[0] >= span:
                    kept.popleft()
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                admitted.append(ok)
            own = ~frame["_seed"]
            yield pd.DataFrame({
                "request_id": frame["request_id"][own],
                "admitted": pd.Series(admitted, index=frame.index, dtype=bool)[own],
            })

    return run


def admitted(
    requests: DataFrame, key: str = "ip", limit: int | str = S.RATE_LIMIT, window: int = S.RATE_WINDOW_SEC
) -> DataFrame:
    """Adds admitted to (key, t, request_id, ...) rows; exact. ``limit``: a number, or the column of each request's own.

    A request with fewer than ``limit`` requests of any kind before it in its window is admitted whatever
    happened to those; it needs no state. A slot after such a calm slot starts with known history (all
    requests of the calm slot). So a client's time line falls into stretches that are independent of each
    other; only stretches with doubtful requests are walked in order, in a stream of Arrow batches."""
    span = window * MICROS
    own = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    counted = trailing_count(requests, key, window).withColumn("_limit", own.cast("long")).withColumns({
        "_slot": F.expr(f"(t - pmod(t, {span})) div {span}"), "_calm": F.col("n_recent") <= F.col("_limit"),
    })
    slots = counted.groupBy(key, "_slot").agg(F.every("_calm").alias("_all_calm"))
    order = Window.partitionBy(key).orderBy("_slot")
    fresh = (F.lag("_slot").over(order).isNull() | (F.lag("_slot").over(order) < F.col("_slot") - 1)
             | F.lag("_all_calm").over(order))
    stretches = slots.withColumn("_from", F.when(fresh, F.col("_slot"))).withColumn(
        "_stretch", F.max("_from").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_from")
    doubtful = stretches.filter(~F.col("_all_calm")).select(key, "_stretch").distinct()
    walked_slots = stretches.join(doubtful, [key, "_stretch"], "left_semi").select(
        key, "_slot", "_stretch", F.lit(False).alias("_seed"))
    seeds = doubtful.select(key, (F.col("_stretch") - 1).alias("_slot"), "_stretch", F.lit(True).alias("_seed"))
    narrow = counted.select(key, "_slot", "t", "request_id", "_limit")
    rows = narrow.join(walked_slots.unionByName(seeds), [key, "_slot"]).select(
        F.col(key).cast("string").alias("_key"), "_stretch", "t", "request_id", "_limit", "_seed")
    ordered = rows.repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "t", "request_id")
    id_type = dict(requests.dtypes)["request_id"]
    walked = ordered.mapInPandas(_walk(span), f"request_id {id_type}, admitted BOOLEAN")
    return (
        counted.drop("n_recent", "_slot", "_limit").join(walked, "request_id", "left")
        .withColumn("admitted", F.coalesce("admitted", F.lit(True))).drop("_calm")
    )


def admit_stream(
    requests: DataFrame, base: str, limit: int | str = S.RATE_LIMIT, window: int = S.RATE_WINDOW_SEC
) -> DataFrame:
    """Decides a stream of (ip, t, request_id) micro-batch by micro-batch and returns all decisions.

    What is carried over are the admitted requests of the last ``window`` before the newest request, so at most as many rows
    as its limit for every client active in that time; a client that falls silent leaves the state. They are put in front of
    the new ones and decided again together with them: among admitted requests alone each is admitted again, so they are
    exactly the memory the rule needs. Every batch thus runs the batch operator, which spreads busy clients; nothing of a
    client is gathered in one task. Requests are expected in the order of time from batch to batch.

    The state is a table with a version a micro-batch; a batch that is repeated after a failure starts from the version
    before its own."""
    spark, span = requests.sparkSession, window * MICROS
    names = ["ip", "t", "request_id", *([limit] if isinstance(limit, str) else [])]
    state, schema = f"{base}/state", T.StructType([requests.schema[c] for c in names])

    def each(rows: DataFrame, number: int) -> None:
        version = V.latest_version(spark, state)
        noted = {"batch": -1, "newest": None} if version is None else V.entry(spark, state, version)
        if noted["batch"] >= number:
            return
        new = rows.select(*names, F.lit(False).alias("past"))
        if version is not None:
            past = V.read_version(spark, state, version, schema)
            new = new.unionByName(past.select(*names, F.lit(True).alias("past")))
        path = batch_folder(f"{base}/decided", number)
        admitted(new, "ip", limit, window).select(*names, "past", "admitted").write.mode("overwrite").parquet(path)
        decided = spark.read.parquet(path)
        newest = decided.agg(F.max("t")).first()[0]
        newest = max((t for t in (newest, noted["newest"]) if t is not None), default=None)
        kept = V.new_data(state)
        live = decided.filter(F.col("admitted") & (F.lit(newest) - F.col("t") < span)) if newest is not None else decided
        live.select(*names).write.parquet(f"{state}/{kept}")
        if V.commit(spark, state, (version or 0) + 1, [kept], batch=number, newest=newest):
            V.retire(spark, state)

    drain(requests, each, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/decided").filter("NOT past").select("ip", "request_id", "admitted")


def carried(spark: SparkSession, base: str) -> DataFrame:
    """The rows that ``admit_stream`` carries over to its next micro-batch."""
    return V.read_latest(spark, f"{base}/state")
