"""Streams over landed articles and events, run to the end of what is there, and request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.operators import analytics as A
from newsmart.plans.bindings import (
    ANSWERED, NEWS, article_keys, articles, batched_articles, pick, responses, retry_responses, sql, table,
)
from newsmart.plans.catalog import ORACLES, query
from newsmart.plans.news_history import PROGRESS_SQL, STEPS
from newsmart.plans.news_mart import DLQ_BODY, DLQ_SQL, PASS_AT, shown_time
from newsmart.streaming import limits as L
from newsmart.streaming import runs as R


def landed(df, spark, name, *keys, files=4):
    """Writes rows as the files that a stream then reads; equal keys share a file."""
    folder = R.new_folder(spark, f"landing/{name}")
    df.repartition(files, *keys).write.parquet(folder)
    return folder


def landed_events(df, spark, name):
    """Events as files of four stretches of time, the earlier ones first."""
    folder = R.new_folder(spark, f"landing/{name}")
    for day in range(0, 32, 8):
        part = df.filter(f"day(ts) BETWEEN {day} AND {day + 7}")
        part.coalesce(1).write.mode("append").parquet(folder)
    return R.file_stream(spark, folder, df.schema, files_per_batch=1)


def event_stream(spark, sf):
    return R.file_stream(spark, sf, table(spark, sf, "events").schema, only="events.parquet")


@query("stream_kpis", ORACLES["kpis"])
def stream_kpis(spark, sf):
    """KPIs kept up to date while articles arrive in several micro-batches."""
    rows = articles(spark, sf).select("article_id", "source", "places")
    folder = landed(rows, spark, "articles", "article_id")
    base, keys = R.new_folder(spark, "kpis"), ["kind", "value"]
    counts = R.running_counts(R.file_stream(spark, folder, rows.schema, files_per_batch=2))
    R.keep_state(counts, base, keys)
    return A.kpis_of(R.kept_state(spark, base, keys, counts.schema))


@query("stream_dedup", sql(*NEWS, body="SELECT DISTINCT url, article_id FROM articles"))
def stream_dedup(spark, sf):
    rows = article_keys(spark, sf).select(
        "url", "article_id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, pos)").alias("arrived"))
    folder = landed(rows, spark, "arrivals", "article_id")
    stream = R.file_stream(spark, folder, rows.schema, files_per_batch=2)
    path = R.append_files(R.unique_arrivals(stream, ["url"], "arrived", "365 days"), R.new_folder(spark, "unique"))
    return spark.read.parquet(path).select("url", "article_id")


@query("stream_progress", sql(PROGRESS_SQL, body="SELECT * FROM latest_progress"))
def stream_progress(spark, sf):
    share = F.from_json("props", "k INT")["k"]
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "props")
    reports = landed_events(events, spark, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        share.cast("float").alias("progress_pct"), pick(STEPS, share % len(STEPS)).alias("current_step"))
    base, last = R.new_folder(spark, "progress"), R.latest_progress(reports)
    R.keep_state(last, base, ["run_id"])
    return R.kept_state(spark, base, ["run_id"], last.schema)


@query("stream_timeline", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY day")
def stream_timeline(spark, sf):
    events = landed_events(table(spark, sf, "events").select("ts"), spark, "days")
    base, days = R.new_folder(spark, "timeline"), R.daily_counts(events.select(F.col("ts").cast("timestamp").alias("ts")))
    R.keep_state(days, base, ["day"])
    return R.kept_state(spark, base, ["day"], days.schema)


def _enriched(spark, sf):
    """The first batches of all runs arrive first, the rest in a second micro-batch, when the stream is taken up again. Either
    part lands in as many files as the session's shuffles have parts, so no task writes a fixed share of all articles."""
    rows = batched_articles(spark, sf).select("article_id", "execution_id", "batch_no", "pos", "source", "places")
    landing, folder, base = R.new_folder(spark, "landing/all"), R.new_folder(spark, "landing/batches"), R.new_folder(spark, "enrich")
    rows.write.parquet(landing)
    there = spark.read.schema(rows.schema).parquet(landing)
    targets = there.groupBy("execution_id").agg(F.count(F.lit(1)).alias("target"))
    for part in ("batch_no < 2", "batch_no >= 2"):
        there.filter(part).repartition("execution_id", "batch_no").write.mode("append").parquet(folder)
        R.enrich_stream(
            R.file_stream(spark, folder, rows.schema), responses, retry_responses, base,
            ["article_id", "execution_id", "outcome", F.col("sentiment_score").cast("double").alias("sentiment_score"),
             F.size("entities_list").alias("entity_count")], targets, F.lit(PASS_AT))
    return base


@query("stream_enrich", sql(*ANSWERED, body="""
SELECT article_id, execution_id, outcome, sentiment_score::DOUBLE AS sentiment_score, n_entities::INT AS entity_count
FROM settled WHERE outcome <> 'dlq'"""))
def stream_enrich(spark, sf):
    return spark.read.parquet(f"{_enriched(spark, sf)}/metrics").drop("batch")


@query("stream_dlq", sql(*ANSWERED, DLQ_SQL, body=DLQ_BODY))
def stream_dlq(spark, sf):
    return shown_time(spark.read.parquet(f"{_enriched(spark, sf)}/dlq").drop("batch"))


@query("stream_article_events", sql(*ANSWERED, body="""
SELECT execution_id, article_id, outcome, row_number() OVER (PARTITION BY execution_id ORDER BY article_id) AS current,
       count(*) OVER (PARTITION BY execution_id) AS target
FROM settled"""))
def stream_article_events(spark, sf):
    """Progress rows of the enrichment stream: current of target articles of their run, over all micro-batches."""
    return spark.read.parquet(f"{_enriched(spark, sf)}/events").drop("batch")


# --- request limits -----------------------------------------------------------------------------

EPOCH = 1_704_067_200_000_000  # 2024-01-01 in microseconds


def requests(events):
    """events -> requests: the event type is the client, time runs 200 times as fast."""
    return events.select(
        L.client(F.concat("event_type", F.lit(" , 10.0.0.1")), F.lit(None)).alias("ip"),
        F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH}) div 200").alias("t"),
        F.col("event_id").alias("request_id"))


REQUESTS_SQL = f"""
requests AS (SELECT event_type AS ip, (epoch_us(ts) - {EPOCH}) // 200 AS t, event_id AS request_id FROM events)"""


@query("trailing_count", sql(REQUESTS_SQL, body="""
SELECT request_id, count(*) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n_recent
FROM requests"""))
def trailing_count(spark, sf):
    return L.trailing_count(requests(table(spark, sf, "events"))).select("request_id", "n_recent")


_WALK_SQL = """
seq AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t, request_id) AS rn FROM limited),
walk AS (
  SELECT ip, rn, request_id, true AS admitted, [t] AS kept FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.ip, s.rn, s.request_id, len(list_filter(w.kept, lambda x: s.t - x < 60000000)) < s.most,
         CASE WHEN len(list_filter(w.kept, lambda x: s.t - x < 60000000)) < s.most
              THEN list_append(list_filter(w.kept, lambda x: s.t - x < 60000000), s.t)
              ELSE list_filter(w.kept, lambda x: s.t - x < 60000000) END
  FROM walk w JOIN seq s ON s.ip = w.ip AND s.rn = w.rn + 1)
SELECT ip, request_id, admitted FROM walk"""
_ADMITTED_SQL = f"WITH RECURSIVE {REQUESTS_SQL}, limited AS (SELECT *, {S.RATE_LIMIT} AS most FROM requests), {_WALK_SQL}"


@query("rate_limit", _ADMITTED_SQL)
def rate_limit(spark, sf):
    return L.admitted(requests(table(spark, sf, "events"))).select("ip", "request_id", "admitted")


@query("stream_rate_limit", _ADMITTED_SQL)
def stream_rate_limit(spark, sf):
    stream = requests(event_stream(spark, sf))
    return L.admit_stream(stream, R.new_folder(spark, "limits"))


DISCOVERY_SQL = f"""WITH RECURSIVE limited AS (
  SELECT 'u' || user_id % 7 AS ip, (epoch_us(ts) - {EPOCH}) // 4000 AS t, event_id AS request_id,
         CASE WHEN event_type IN ('view', 'click') THEN {S.DISCOVERY_RATE_LIMIT} ELSE {S.RATE_LIMIT} END AS most
  FROM events), {_WALK_SQL}"""


def mixed_requests(events):
    """events -> requests of few clients; views and clicks are discoveries, with a limit of their own."""
    kind = F.when(F.col("event_type").isin("view", "click"), S.DISCOVERY_RATE_LIMIT).otherwise(S.RATE_LIMIT)
    return events.select(
        F.concat(F.lit("u"), F.col("user_id") % 7).alias("ip"),
        F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH}) div 4000").alias("t"),
        F.col("event_id").alias("request_id"), kind.alias("most"))


@query("discovery_limit", DISCOVERY_SQL)
def discovery_limit(spark, sf):
    """Discovery (15 a minute) and other requests (10) of a client count against each other."""
    return L.admitted(mixed_requests(table(spark, sf, "events")), limit="most").select("ip", "request_id", "admitted")


@query("stream_discovery_limit", DISCOVERY_SQL)
def stream_discovery_limit(spark, sf):
    """The same over four micro-batches; clients that fall silent leave the state."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    stream = mixed_requests(landed_events(events, spark, "requests"))
    return L.admit_stream(stream, R.new_folder(spark, "limits"), "most")
