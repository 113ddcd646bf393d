"""Run history, jobs, progress and queue views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.dates import iso_utc, minutes_seconds, seconds_between
from newsmart.functions.text import blank_to_null
from newsmart.operators.ranking import first_rows, range_position


def history_list(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """Runs with their article counts (0 included), newest scrape first. Articles shrink to one row per
    run before the join."""
    counts = articles.groupBy("execution_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        runs.join(counts, "execution_id", "left")
        .withColumn("total_articles", F.coalesce("_n", F.lit(0))).drop("_n")
        .orderBy(F.coalesce("scraped_at", "timestamp").desc_nulls_first(), "execution_id")
    )


def history_filter(
    history: DataFrame, search: str = "", status: str = "ALL", hide_zero: bool = False
) -> DataFrame:
    """Text search in term and filters; ANALYZED / RAW; runs without articles can be hidden."""
    out = history
    if search:
        needle = search.lower()
        out = out.filter(
            F.lower(F.coalesce("search_term", F.lit(""))).contains(needle)
            | F.lower(F.coalesce("filters", F.lit("{}"))).contains(needle)
        )
    analyzed = F.coalesce("status", F.lit("")) == "COMPLETED"
    if status == "ANALYZED":
        out = out.filter(analyzed)
    elif status == "RAW":
        out = out.filter(~analyzed)
    return out.filter(F.col("total_articles") > 0) if hide_zero else out


def next_sort(current: tuple[str, str], column: str, default: str) -> tuple[str, str]:
    """Sort after a click: new column descending, then ascending, then back to the default."""
    if current[0] != column:
        return column, "desc"
    return {"desc": (column, "asc"), "asc": (default, "desc")}.get(current[1], (column, "desc"))


def _directed(c: Column, direction: str) -> Column:
    return c.asc() if direction == "asc" else c.desc()


def history_order(column: str, direction: str) -> list[Column]:
    key = {
        "search_term": F.lower(F.coalesce("search_term", F.lit(""))),
        "total_articles": F.col("total_articles"),
    }.get(column, F.coalesce("scraped_at", "timestamp"))
    return [_directed(key, direction), F.col("execution_id").asc()]


def latest_progress(events: DataFrame) -> DataFrame:
    """Last reported progress per run; a hot run shrinks to one row per map task before the shuffle."""
    last = F.max_by(F.struct("progress_pct", "current_step"), F.struct("ts", "event_id"))
    return events.groupBy("run_id").agg(last.alias("_l")).select("run_id", "_l.*")


def with_progress(runs: DataFrame, progress: DataFrame, key: str = "execution_id") -> DataFrame:
    """Progress of each run; runs that never reported stand at 0 with the starting step."""
    return (
        runs.join(progress.withColumnRenamed("run_id", key), key, "left")
        .withColumn("progress_pct", F.coalesce("progress_pct", F.lit(0).cast("float")))
        .withColumn("current_step", F.coalesce("current_step", F.lit(S.DEFAULT_STEP)))
    )


def job_rows(runs: DataFrame) -> DataFrame:
    return runs.select(
        F.col("execution_id").alias("run_id"), "status", F.col("search_term").alias("query"),
        F.col("timestamp").alias("start_time"), "end_time",
    )


def jobs_list(runs: DataFrame, events: DataFrame, k: int = 20) -> DataFrame:
    """The latest runs with progress. The few runs are picked first, so only their events are read on."""
    latest = job_rows(runs.orderBy(F.col("timestamp").desc(), "execution_id").limit(k))
    theirs = events.join(latest.select("run_id"), "run_id", "left_semi")
    return with_progress(latest, latest_progress(theirs), "run_id").select(
        "run_id", "status", "query", iso_utc(F.col("start_time")).alias("start_time"),
        iso_utc(F.col("end_time")).alias("end_time"), "progress_pct", "current_step",
    )


def jobs_filter(jobs: DataFrame, search: str = "", group: str = "ALL") -> DataFrame:
    out = jobs
    if search:
        needle = search.lower()
        out = out.filter(
            F.lower(F.coalesce("query", F.lit(""))).contains(needle)
            | F.lower(F.coalesce("run_id", F.lit(""))).contains(needle)
        )
    if group in S.JOB_STATUS_GROUPS:
        out = out.filter(F.col("status").isin(S.JOB_STATUS_GROUPS[group]))
    return out


def elapsed_seconds(now: Column) -> Column:
    """Duration of a job; open jobs run until now, other jobs without an end count 0."""
    end = F.coalesce(
        "end_time", F.when(F.col("status").isin(S.OPEN_ENDED_STATUSES), now).otherwise(F.col("start_time"))
    )
    return F.coalesce(F.greatest(F.lit(0), seconds_between(F.col("start_time"), end)), F.lit(0))


def elapsed_label(now: Column) -> Column:
    return F.when(F.col("start_time").isNull(), "-").otherwise(minutes_seconds(elapsed_seconds(now)))


def jobs_order(column: str, direction: str, now: Column) -> list[Column]:
    key = {
        "query": F.lower(F.coalesce("query", F.lit(""))),
        "status": F.lower(F.coalesce("status", F.lit(""))),
        "elapsed": elapsed_seconds(now),
    }.get(column, F.coalesce("end_time", "start_time"))
    return [_directed(key, direction), F.col("run_id").asc()]


def queue_position(runs: DataFrame) -> DataFrame:
    """Place of every queued run in the waiting line (oldest first); only queued rows are numbered."""
    queued = runs.filter(F.col("status") == "QUEUED_FOR_ANALYSIS")
    return range_position(queued, [F.col("timestamp"), F.col("execution_id")], "queue_position")


def next_queued(runs: DataFrame) -> DataFrame:
    queued = runs.filter(F.col("status") == "QUEUED_FOR_ANALYSIS")
    return queued.orderBy("timestamp", "execution_id").limit(1)


def apply_transitions(runs: DataFrame, transitions: DataFrame) -> DataFrame:
    """Last status change per run; starting an analysis clears the end, finishing one sets it."""
    last = transitions.groupBy("execution_id").agg(
        F.max_by(F.struct(F.col("status").alias("_status"), F.col("ts").alias("_ts")), F.struct("ts", "event_id"))
        .alias("_l")
    ).select("execution_id", "_l.*")
    ended = F.col("_status").isin("COMPLETED", "PARTIALLY_ANALYZED")
    return (
        runs.join(last, "execution_id", "left")
        .withColumn("end_time", F.when(ended, F.col("_ts")).when(F.col("_status") == "ANALYZING", None)
                    .otherwise(F.col("end_time")))
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status", "_ts")
    )


def run_detail(runs: DataFrame, articles: DataFrame, execution_id: str) -> DataFrame:
    """One run and its articles, a row per article (one row with empty article columns when it has none)."""
    run = runs.filter(F.col("execution_id") == execution_id)
    theirs = articles.filter(F.col("execution_id") == execution_id)
    return run.join(theirs, "execution_id", "left").orderBy("article_id")


def aggregated_runs(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """Each article once over the chosen runs, taken from the run scraped last, with that run's term."""
    chosen = runs.select("execution_id", F.col("search_term").alias("origin_search_term"), "scraped_at")
    joined = articles.join(chosen, "execution_id")
    return first_rows(
        joined, ["article_id"], [F.col("scraped_at").desc_nulls_last(), F.col("execution_id")]
    ).drop("scraped_at")


def recent_terms(runs: DataFrame, k: int = 10) -> DataFrame:
    """Last distinct search terms, newest first."""
    last = runs.groupBy("search_term").agg(F.max("timestamp").alias("last_used"))
    return last.orderBy(F.col("last_used").desc(), "search_term").limit(k)


def run_kind() -> list[Column]:
    """Badge, analyzed/raw and empty flag of a history row."""
    status = F.col("status")
    badge = F.when(status == "COMPLETED", "Analyzed").when(status == "SCRAPED", "Raw Articles").otherwise(status)
    return [
        badge.alias("badge"),
        F.when(status.eqNullSafe("COMPLETED"), "analyzed").otherwise("raw").alias("run_type"),
        (F.col("total_articles") == 0).alias("is_empty"),
    ]


def run_chips(runs: DataFrame, by: str, shown: int = S.CHIPS_SHOWN) -> DataFrame:
    """(by, chips): labels of the first runs of each selection (by execution_id), and how many more there are. Only these
    first runs and a count leave a task, however many runs a selection has."""
    label = F.coalesce(blank_to_null(F.col("search_term")), F.substring("execution_id", 1, 8))
    named = runs.select(by, "execution_id", label.alias("label"))
    first = first_rows(named, [by], [F.col("execution_id")], shown).groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("execution_id", "label")))["label"].alias("_first"))
    counts = named.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    more = F.when(F.col("_n") > shown, F.array(F.concat(F.lit("+"), F.col("_n") - shown, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return first.join(counts, by).select(by, F.concat("_first", more).alias("chips"))
