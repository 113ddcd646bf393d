"""Run history, jobs, progress, queue, search requests and selection over the bound runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions import dates as D
from newsmart.functions import nested as N
from newsmart.functions import text as X
from newsmart.operators import dedup as U
from newsmart.operators import export as P
from newsmart.operators import history as H
from newsmart.operators.requests import rejections
from newsmart.plans.bindings import (
    ARTICLES_SQL, BATCHED, EXECUTIONS_SQL, NEWS, RUNS, RUNS_NEWS, article_keys, articles, batched_articles, executions,
    pick, sql, table, with_places, with_text,
)
from newsmart.plans.catalog import query
from newsmart.sources import regions as G
from newsmart.sources.feeds import unresolved
from newsmart.sources.tables import append_rows, merge_rows, read_table
from newsmart.sources.versions import new_folder

NOW = "2024-01-02 12:00:00"
STEPS = ["Fetching discovery (10%)...", "Analyzing articles (3/9)...", "Extracting text from articles...",
         "Analysis complete."]
_STEPS_SQL = "[" + ",".join(f"'{s}'" for s in STEPS) + "]"


def now():
    return F.to_timestamp(F.lit(NOW))


def progress_events(spark, sf):
    """events -> progress reports of runs."""
    share = F.from_json("props", "k INT")["k"]
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        share.cast("float").alias("progress_pct"), pick(STEPS, share % len(STEPS)).alias("current_step"))


PROGRESS_SQL = f"""
progress AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, ts, event_id, CAST(regexp_extract(props, '[0-9]+') AS FLOAT) AS progress_pct,
         {_STEPS_SQL}[CAST(regexp_extract(props, '[0-9]+') AS INT) % 4 + 1] AS current_step FROM events),
latest_progress AS (
  SELECT run_id, arg_max(progress_pct, (ts, event_id)) AS progress_pct, arg_max(current_step, (ts, event_id)) AS current_step
  FROM progress GROUP BY run_id)"""

HISTORY_SQL = """
all_runs AS (
  SELECT * FROM executions
  UNION ALL SELECT 'empty-' || n_nationkey, TIMESTAMP '2024-02-01' + to_minutes(n_nationkey), 'Nothing in ' || n_name,
    '{"country":"' || n_name || '"}', n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'SCRAPED' ELSE 'COMPLETED' END, NULL, NULL FROM nation),
history AS (
  SELECT e.*, coalesce(n, 0) AS total_articles FROM all_runs e
  LEFT JOIN (SELECT execution_id, count(*) AS n FROM articles GROUP BY execution_id) USING (execution_id))"""
HISTORY = (*RUNS_NEWS, HISTORY_SQL)


def history(spark, sf):
    """Runs with counts; a run for each nation has found nothing."""
    empty = table(spark, sf, "nation").select(
        F.concat(F.lit("empty-"), "n_nationkey").alias("execution_id"),
        F.expr("timestamp'2024-02-01 00:00:00' + make_interval(0, 0, 0, 0, 0, n_nationkey)").alias("timestamp"),
        F.concat(F.lit("Nothing in "), "n_name").alias("search_term"), F.concat(F.lit('{"country":"'), "n_name", F.lit('"}')).alias("filters"),
        F.when(F.col("n_nationkey") % 2 == 0, "SCRAPED").otherwise("COMPLETED").alias("status"),
        F.lit(None).cast("timestamp").alias("end_time"), F.lit(None).cast("timestamp").alias("scraped_at"))
    return H.history_list(executions(spark, sf).unionByName(empty), article_keys(spark, sf))


@query("history_list", sql(*HISTORY, body="""
SELECT execution_id, search_term, status, filters, total_articles FROM history"""))
def history_list(spark, sf):
    return history(spark, sf).select("execution_id", "search_term", "status", "filters", "total_articles")


@query("history_filter", sql(*HISTORY, body="""
SELECT execution_id, status, total_articles FROM history
WHERE (contains(lower(search_term), 'nation_1') OR contains(lower(filters), 'nation_1'))
  AND status <> 'COMPLETED' AND total_articles > 0"""))
def history_filter(spark, sf):
    found = H.history_filter(history(spark, sf), "NATION_1", "RAW", hide_zero=True)
    return found.select("execution_id", "status", "total_articles")


@query("history_sorted", sql(*HISTORY, body="""
SELECT execution_id, search_term, total_articles FROM history ORDER BY lower(search_term) DESC, execution_id"""))
def history_sorted(spark, sf):
    """After two clicks: term descending, and the rows in that order."""
    column, direction = H.next_sort(("scraped_at", "desc"), "search_term", "scraped_at")
    return history(spark, sf).orderBy(*H.history_order(column, direction)).select(
        "execution_id", "search_term", "total_articles")


@query("run_type", sql(*HISTORY, body="""
SELECT execution_id, CASE status WHEN 'COMPLETED' THEN 'Analyzed' WHEN 'SCRAPED' THEN 'Raw Articles' ELSE status END AS badge,
       CASE WHEN status = 'COMPLETED' THEN 'analyzed' ELSE 'raw' END AS run_type, total_articles = 0 AS is_empty FROM history"""))
def run_type(spark, sf):
    return history(spark, sf).select("execution_id", *H.run_kind())


@query("filter_chips", sql(*RUNS, body="""
SELECT execution_id, 'country:' || country || ' query:' || search_term AS chips,
       search_term AS label, 'All time' AS dates FROM executions"""))
def filter_chips(spark, sf):
    stored = F.from_json("filters", "map<string,string>")
    return executions(spark, sf).select(
        "execution_id", N.filter_chips(F.col("filters")).alias("chips"),
        F.coalesce(X.blank_to_null(F.col("search_term")), F.substring("execution_id", 1, 8)).alias("label"),
        F.coalesce(F.try_element_at(stored, F.lit("qrangedate")), F.lit("All time")).alias("dates"))


@query("run_chips", sql(*RUNS, """
numbered AS (SELECT status, search_term, row_number() OVER (PARTITION BY status ORDER BY execution_id) AS rn,
                    count(*) OVER (PARTITION BY status) AS n FROM executions)""", body="""
SELECT status, string_agg(search_term, ' | ' ORDER BY rn) FILTER (WHERE rn <= 3) ||
       CASE WHEN any_value(n) > 3 THEN ' | +' || any_value(n) - 3 || ' more' ELSE '' END AS chips FROM numbered GROUP BY status"""))
def run_chips(spark, sf):
    """Chips of a view over all runs of a status."""
    return H.run_chips(executions(spark, sf), "status").select("status", F.array_join("chips", " | ").alias("chips"))


@query("trigger_label", sql(*NEWS, body="""
SELECT article_id, execution_id, CASE len(coalesce(places, [])) WHEN 0 THEN 'All States' WHEN 1 THEN places[1] ELSE len(places) || ' States' END AS label
FROM articles"""))
def trigger_label(spark, sf):
    """Button text if the places of an article were the ones picked."""
    return articles(spark, sf).select("article_id", "execution_id", N.trigger_label(F.col("places"), "State").alias("label"))


@query("execution_country", sql(*RUNS, body="""
SELECT execution_id, CASE CAST(execution_id AS INT) % 4 WHEN 0 THEN 'mx' WHEN 1 THEN 'mx' ELSE country END AS country
FROM executions"""))
def execution_country(spark, sf):
    """Every fourth run has broken filters, every fourth a blank country."""
    kind = F.col("execution_id").cast("int") % 4
    text = F.when(kind == 0, F.concat(F.lit("{broken "), "filters")).when(
        kind == 1, F.lit('{"country":"","query":"x"}')).otherwise(F.col("filters"))
    return executions(spark, sf).select("execution_id", N.run_country(text).alias("country"))


@query("country_config", sql(EXECUTIONS_SQL, body="""
SELECT execution_id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'mx' END AS key,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Country of ' || n_name ELSE 'Mexico' END AS country_name,
       CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'es' END AS hl,
       CASE WHEN n_nationkey % 2 = 0 THEN 1.5 ELSE 23.6345 END::DOUBLE AS lat, CASE WHEN n_nationkey % 2 = 0 THEN 2.5 ELSE -102.5528 END::DOUBLE AS lon,
       CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 5 END::INT AS zoom, n_nationkey % 2 = 1 AS has_hints,
       n_nationkey % 2 = 1 OR n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey) AS has_map
FROM executions JOIN nation ON country = n_name"""))
def country_config(spark, sf):
    """Settings per run: every second nation has its own, the others fall back to the default country.
    The first nation of each region has a map."""
    nation = table(spark, sf, "nation")
    text = F.concat(
        F.lit('{"'), F.lower("n_name"), F.lit('":{"country_name":"Country of '), "n_name",
        F.lit('","center":[1.5,2.5],"zoom":4,"hl":"en","gl":"US","ceid":"US:en"}}'))
    own = G.config_rows(nation.filter(F.col("n_nationkey") % 2 == 0).select(text.alias("config")))
    fixed = G.config_rows(spark.range(1).select(F.lit(G.default_config_json()).alias("config")))
    settings = own.unionByName(fixed)
    first = nation.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("n"))
    mapped = G.with_map(settings, first.select(F.lower("n").alias("country")).unionByName(
        spark.range(1).select(F.lit(S.DEFAULT_COUNTRY).alias("country"))))
    runs = G.resolve_country(executions(spark, sf), settings)
    flags = mapped.select("key", F.lit(True).alias("has_map"))
    return runs.join(flags, "key", "left").select(
        "execution_id", "key", "country_name", "hl", "lat", "lon", "zoom", (F.col("llm_hints") != "").alias("has_hints"), F.coalesce("has_map", F.lit(False)).alias("has_map"))


@query("regions_scan", """
SELECT lower(r_name) AS country, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INT AS pos,
       n_name AS state_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def regions_scan(spark, sf):
    """One GeoJSON text per region of the world, its nations as features (one unnamed feature at the end)."""
    named = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"state_name":"'), "n_name", F.lit('"}}'))
    files = named.groupBy(F.lower("r_name").alias("country")).agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", feature.alias("f")))).alias("l"))
    geojson = F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.col("l")["f"], ","),
        F.lit(',{"properties":{"state_name":""}}]}'))
    return G.region_rows(files.select("country", geojson.alias("geojson")))


@query("by_execution", sql(*NEWS, body="""
SELECT article_id, execution_id, date, source FROM articles WHERE execution_id = '7'"""))
def by_execution(spark, sf):
    return with_places(article_keys(spark, sf, "7"), spark, sf, few=True).select("article_id", "execution_id", "date", "source")


@query("search_counters", sql(*NEWS, body="""
SELECT execution_id, count(*) AS buffer, count(*) FILTER (good) AS valid, count(DISTINCT url) FILTER (good) AS "unique",
       least(count(DISTINCT url) FILTER (good), 3 + CAST(execution_id AS BIGINT) % 9) AS returned
FROM (SELECT *, length(trim(scraped_text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) > 200 AS good FROM articles) GROUP BY execution_id"""))
def search_counters(spark, sf):
    """Counters of every run; texts are measured once per document before they meet their articles."""
    rows = with_text(article_keys(spark, sf), spark, sf, good=U.long_enough(F.col("scraped_text")))
    counted = U.search_counters(rows.select("execution_id", "url", "good"), ["execution_id"], F.col("url"), F.col("good"),
                                3 + F.col("execution_id").cast("long") % 9)
    return counted.select("execution_id", "buffer", "valid", "unique", "returned")


@query("stored_tables", sql(*RUNS_NEWS, body="""
SELECT a.article_id, a.execution_id, a.url, a.date, a.source, a.geodata, a.image_url, e.status, e.search_term, e.country
FROM articles a JOIN executions e USING (execution_id)"""))
def stored_tables(spark, sf):
    """Runs and articles stored in two loads each and read back by their layouts."""
    root = new_folder(spark, "mart")
    runs = executions(spark, sf).withColumn("filters", F.from_json("filters", "map<string,string>"))
    news = articles(spark, sf).select("article_id", "execution_id", "url", "date", "source", "geodata", "image_url")
    early = F.col("date") < "1996-01-01"
    append_rows(root, "articles", news.filter(early))
    merge_rows(spark, root, "articles", lambda old: old.unionByName(news.filter(~early), allowMissingColumns=True))
    append_rows(root, "search_executions", runs)
    stored, of = read_table(spark, root, "articles"), read_table(spark, root, "search_executions")
    return stored.join(of, "execution_id").select(
        "article_id", "execution_id", "url", "date", "source", "geodata", "image_url", "status", "search_term",
        F.try_element_at("filters", F.lit("country")).alias("country"))


@query("by_execution_set", sql(*RUNS_NEWS, body="""
SELECT article_id, execution_id FROM articles
WHERE execution_id IN (SELECT execution_id FROM executions WHERE search_term = 'MACHINERY')"""))
def by_execution_set(spark, sf):
    """A long list of runs is a table of its own: semi join."""
    chosen = executions(spark, sf).filter(F.col("search_term") == "MACHINERY").select("execution_id")
    return article_keys(spark, sf).join(chosen, "execution_id", "left_semi").select("article_id", "execution_id")


@query("run_detail", sql(*RUNS_NEWS, body="""
SELECT execution_id, search_term, status, article_id, url, date FROM executions LEFT JOIN articles USING (execution_id)
WHERE execution_id = '11'"""))
def run_detail(spark, sf):
    return H.run_detail(executions(spark, sf, "11"), article_keys(spark, sf, "11"), "11").select(
        "execution_id", "search_term", "status", "article_id", "url", "date")


@query("jobs_by_status", sql(*RUNS, body="""
SELECT execution_id, search_term, status, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at FROM executions
WHERE status IN ('SCRAPING', 'SCRAPED', 'ANALYZING')"""))
def jobs_by_status(spark, sf):
    ongoing = executions(spark, sf).filter(F.col("status").isin(S.ONGOING_STATUSES))
    return ongoing.select("execution_id", "search_term", "status",
                          F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@query("progress_latest", sql(PROGRESS_SQL, body="SELECT * FROM latest_progress"))
def progress_latest(spark, sf):
    return H.latest_progress(progress_events(spark, sf))


@query("job_progress", sql(*RUNS, PROGRESS_SQL, body="""
SELECT execution_id, coalesce(progress_pct, 0::FLOAT) AS progress_pct, coalesce(current_step, 'Starting...') AS current_step
FROM executions LEFT JOIN latest_progress ON run_id = execution_id"""))
def job_progress(spark, sf):
    runs = executions(spark, sf).select("execution_id")
    return H.with_progress(runs, H.latest_progress(progress_events(spark, sf))).select(
        "execution_id", "progress_pct", "current_step")


@query("jobs_list", sql(*RUNS, PROGRESS_SQL, body="""
SELECT execution_id AS run_id, status, search_term AS query, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '+00:00' AS start_time,
       strftime(end_time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS end_time,
       coalesce(progress_pct, 0::FLOAT) AS progress_pct, coalesce(current_step, 'Starting...') AS current_step
FROM executions LEFT JOIN latest_progress ON run_id = execution_id ORDER BY "timestamp" DESC, execution_id LIMIT 20"""))
def jobs_list(spark, sf):
    return H.jobs_list(executions(spark, sf), progress_events(spark, sf))


@query("jobs_filter", sql(*RUNS, body="""
SELECT execution_id AS run_id, status, search_term AS query FROM executions
WHERE status IN ('QUEUED_FOR_ANALYSIS', 'ANALYZING', 'SCRAPING', 'STARTED', 'STARTING')
  AND (contains(lower(search_term), 'ur') OR contains(execution_id, 'ur'))"""))
def jobs_filter(spark, sf):
    jobs = H.job_rows(executions(spark, sf))
    return H.jobs_filter(jobs, "UR", "ACTIVE").select("run_id", "status", "query")


_ELAPSED_SQL = f"""
elapsed AS (
  SELECT execution_id AS run_id, greatest(0, epoch(coalesce(end_time,
    CASE WHEN status IN ('STARTED','STARTING','SCRAPING','QUEUED_FOR_ANALYSIS','ANALYZING') THEN TIMESTAMP '{NOW}'
         ELSE "timestamp" END))::BIGINT - epoch("timestamp")::BIGINT) AS seconds FROM executions)"""


@query("jobs_sorted", sql(*RUNS, _ELAPSED_SQL, body="SELECT run_id, seconds FROM elapsed"))
def jobs_sorted(spark, sf):
    jobs = H.job_rows(executions(spark, sf))
    ordered = jobs.orderBy(*H.jobs_order("elapsed", "asc", now()))
    return ordered.select("run_id", H.elapsed_seconds(now()).cast("long").alias("seconds"))


@query("job_elapsed", sql(*RUNS, _ELAPSED_SQL, body="""
SELECT run_id, CASE WHEN seconds < 600 THEN '0' ELSE '' END || (seconds // 60) || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0')
       AS elapsed FROM elapsed"""))
def job_elapsed(spark, sf):
    return H.job_rows(executions(spark, sf)).select("run_id", H.elapsed_label(now()).alias("elapsed"))


@query("relative_time", sql(*RUNS, f"""
aged AS (SELECT execution_id, coalesce(scraped_at, "timestamp") AS seen,
         greatest(0, epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(coalesce(scraped_at, "timestamp"))::BIGINT) AS s FROM executions)""",
                            body="""
SELECT execution_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || ' mins ago' WHEN s < 7200 THEN '1 hour ago'
       WHEN s < 86400 THEN (s // 3600) || ' hours ago' ELSE strftime(seen, '%d %b') END AS label FROM aged"""))
def relative_time(spark, sf):
    return executions(spark, sf).select(
        "execution_id", D.relative_label(F.coalesce("scraped_at", "timestamp"), now()).alias("label"))


@query("iso_ts", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events""")
def iso_ts(spark, sf):
    return table(spark, sf, "events").select("event_id", D.iso_utc(F.col("ts").cast("timestamp")).alias("iso"))


@query("queue_position", sql(*RUNS, body="""
SELECT execution_id, row_number() OVER (ORDER BY "timestamp", execution_id) AS queue_position FROM executions
WHERE status = 'QUEUED_FOR_ANALYSIS'"""))
def queue_position(spark, sf):
    return H.queue_position(executions(spark, sf)).select("execution_id", "queue_position")


@query("next_queued", sql(*RUNS, body="""
SELECT execution_id, search_term FROM executions WHERE status = 'QUEUED_FOR_ANALYSIS' ORDER BY "timestamp", execution_id LIMIT 1"""))
def next_queued(spark, sf):
    return H.next_queued(executions(spark, sf)).select("execution_id", "search_term")


_MOVES = ["QUEUED_FOR_ANALYSIS", "SCRAPING", "CANCELLED", "ANALYZING", "COMPLETED", "PARTIALLY_ANALYZED"]


@query("execution_status", sql(*RUNS, f"""
moves AS (SELECT CAST(user_id AS VARCHAR) AS execution_id, arg_max(ts, (ts, event_id)) AS ts,
   ['{"','".join(_MOVES)}'][CAST(arg_max(event_id, (ts, event_id)) % 6 AS INT) + 1] AS moved FROM events GROUP BY user_id)""",
                               body="""
SELECT execution_id, coalesce(moved, status) AS status,
       strftime(CASE WHEN moved IN ('COMPLETED', 'PARTIALLY_ANALYZED') THEN ts WHEN moved = 'ANALYZING' THEN NULL ELSE end_time END,
                '%Y-%m-%d %H:%M:%S') AS end_time FROM executions LEFT JOIN moves USING (execution_id)"""))
def execution_status(spark, sf):
    moves = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("execution_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        pick(_MOVES, F.col("event_id") % len(_MOVES)).alias("status"))
    return H.apply_transitions(executions(spark, sf), moves).select(
        "execution_id", "status", F.date_format("end_time", "yyyy-MM-dd HH:mm:ss").alias("end_time"))


@query("recent_search_terms", sql(*RUNS, body="""
SELECT search_term, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS last_used FROM executions GROUP BY search_term
ORDER BY max("timestamp") DESC, search_term LIMIT 10"""))
def recent_search_terms(spark, sf):
    return H.recent_terms(executions(spark, sf)).select(
        "search_term", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@query("progress_pct", """
SELECT event_id, 40.0::DOUBLE + least(value / greatest(k, 1) * 50.0, 50.0) AS scheduled,
       0.0::DOUBLE + least(value / greatest(k, 1) * 100.0, 100.0) AS analyzed
FROM (SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)""")
def progress_pct(spark, sf):
    k = F.from_json("props", "k INT")["k"]
    return table(spark, sf, "events").select(
        "event_id", X.progress_share(F.col("value"), k, 40.0, 50.0).alias("scheduled"),
        X.progress_share(F.col("value"), k).alias("analyzed"))


# --- search requests, selection and exports ---------------------------------------------------

def requests(spark, sf):
    """customer -> filled-in search forms."""
    key = F.col("c_custkey")
    words = lambda kind: F.when(key % 3 == kind, F.concat("c_mktsegment", F.lit(" plan b*~/ñ")))
    return table(spark, sf, "customer").select(
        key.alias("request_id"),
        F.when(key % 7 == 0, " ").otherwise(F.col("c_name")).alias("query"),
        F.coalesce(words(1), F.when(key % 3 == 2, F.col("c_mktsegment")), F.lit("")).alias("qoption"),
        F.coalesce(words(0), F.lit("")).alias("qexception"),
        F.when(key % 5 == 0, "news.example").otherwise("").alias("qsite"),
        F.when(key % 4 == 1, "2024-01-01 to 2024-02-01").when(key % 4 == 2, "2024-03-01").otherwise("").alias("qrangedate"),
        F.when(key % 11 == 3, "many").when(key % 11 == 4, "0").when(key % 11 == 5, None)
        .otherwise((key % 300).cast("string")).alias("nqueries"),
        F.when(key % 13 == 6, None).otherwise("mx").alias("country"))


REQUESTS_SQL = """
requests AS (
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS query,
    CASE c_custkey % 3 WHEN 1 THEN c_mktsegment || ' plan b*~/ñ' WHEN 2 THEN c_mktsegment ELSE '' END AS qoption,
    CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' plan b*~/ñ' ELSE '' END AS qexception,
    CASE WHEN c_custkey % 5 = 0 THEN 'news.example' ELSE '' END AS qsite,
    CASE c_custkey % 4 WHEN 1 THEN '2024-01-01 to 2024-02-01' WHEN 2 THEN '2024-03-01' ELSE '' END AS qrangedate,
    CASE c_custkey % 11 WHEN 3 THEN 'many' WHEN 4 THEN '0' WHEN 5 THEN NULL ELSE CAST(c_custkey % 300 AS VARCHAR) END AS nqueries,
    CASE WHEN c_custkey % 13 = 6 THEN NULL ELSE 'mx' END AS country FROM customer)"""


@query("compose_query", sql(REQUESTS_SQL, """
composed AS (
  SELECT request_id, concat_ws(' ', query,
    CASE WHEN qoption LIKE '% %' THEN '(' || replace(qoption, ' ', ' OR ') || ')' WHEN qoption <> '' THEN qoption END,
    CASE WHEN qexception <> '' THEN '-' || replace(qexception, ' ', ' -') END,
    CASE WHEN qsite <> '' THEN 'site:' || qsite END,
    CASE WHEN qrangedate LIKE '% to %' THEN 'after:' || replace(qrangedate, ' to ', ' before:')
         WHEN qrangedate <> '' THEN 'after:' || qrangedate END) AS final_query FROM requests)""", body="""
SELECT request_id, final_query, replace(url_encode(final_query), '%2F', '/') AS encoded FROM composed"""))
def compose_query(spark, sf):
    composed = requests(spark, sf).select("request_id", X.search_query(
        *[F.col(c) for c in ("query", "qoption", "qexception", "qsite", "qrangedate")]).alias("final_query"))
    return composed.withColumn("encoded", X.percent_encode(F.col("final_query")))


@query("quota", sql(REQUESTS_SQL, body="""
SELECT request_id, least(coalesce(TRY_CAST(nqueries AS INT), 15), 100) AS quota,
       3 * least(coalesce(TRY_CAST(nqueries AS INT), 15), 100) AS buffer FROM requests"""))
def quota(spark, sf):
    n = X.article_quota(F.col("nqueries"))
    return requests(spark, sf).select("request_id", n.alias("quota"), (F.lit(S.CANDIDATE_FACTOR) * n).alias("buffer"))


@query("request_valid", sql(REQUESTS_SQL, body="""
SELECT request_id, concat_ws(',', CASE WHEN trim(query, ' ') = '' THEN 'query' END,
   CASE WHEN coalesce(TRY_CAST(nqueries AS INT), 0) <= 0 THEN 'nqueries' END, CASE WHEN country IS NULL THEN 'country' END) AS rejected
FROM requests"""))
def request_valid(spark, sf):
    return requests(spark, sf).select("request_id", F.array_join(rejections(), ",").alias("rejected"))


@query("strip_nulls", sql(REQUESTS_SQL, body="""
SELECT request_id, '{' || concat_ws(',', '"request_id":' || request_id, '"query":"' || query || '"',
   CASE WHEN qoption <> '' THEN '"qoption":"' || qoption || '"' END, CASE WHEN qsite <> '' THEN '"qsite":"' || qsite || '"' END,
   CASE WHEN request_id % 2 = 0 THEN '"tags":["' || qoption || '"]' END,
   CASE WHEN country IS NOT NULL THEN '"country":"mx"' END) || '}' AS payload FROM requests"""))
def strip_nulls(spark, sf):
    """Blank text, NULL and empty lists go; list elements stay."""
    tags = F.when(F.col("request_id") % 2 == 0, F.array("qoption")).otherwise(F.array())
    return requests(spark, sf).select("request_id", N.compact_json(
        request_id=F.col("request_id"), query=N.drop_blank(F.col("query")), qoption=N.drop_blank(F.col("qoption")),
        qsite=N.drop_blank(F.col("qsite")), tags=N.drop_empty(tags), country=N.drop_blank(F.col("country"))).alias("payload"))


def candidates(spark, sf):
    """Scraped candidates of each run in feed order; every third one has no resolved address."""
    rows = with_text(article_keys(spark, sf), spark, sf, n_chars=F.length(X.strip(F.col("scraped_text"))))
    return rows.withColumn("real_url", F.when(F.col("pos") % 3 == 0, "").otherwise(
        F.concat(F.lit("https://r.example/"), (F.expr("pos div 9")).cast("string"))))


_CANDIDATES_SQL = f"""
candidates AS (SELECT *, CASE WHEN pos % 3 = 0 THEN url ELSE 'https://r.example/' || (pos // 9) END AS link FROM articles),
gated AS (SELECT * FROM candidates WHERE length(trim(scraped_text, chr(32) || chr(9) || chr(10) || chr(13))) > {S.MIN_ARTICLE_CHARS}),
unique_url AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id, link ORDER BY pos) AS rn FROM gated) WHERE rn = 1),
chosen AS (SELECT * FROM (SELECT execution_id, article_id, url, link, pos, row_number() OVER (PARTITION BY execution_id ORDER BY pos) AS rank
             FROM unique_url) WHERE rank <= 3 + CAST(execution_id AS INT) % 5)"""


def gated(spark, sf):
    rows = candidates(spark, sf).filter(F.col("n_chars") > S.MIN_ARTICLE_CHARS)
    return rows.select("execution_id", "article_id", "url", "real_url", "pos")


def chosen(spark, sf):
    n = F.lit(3) + F.col("execution_id").cast("int") % 5
    return U.dedup_url_quota(gated(spark, sf), ["execution_id"], U.link(), [F.col("pos")], n)


@query("quality_gate", sql(*NEWS, _CANDIDATES_SQL, body="SELECT execution_id, article_id, pos FROM gated"))
def quality_gate(spark, sf):
    rows = with_text(article_keys(spark, sf), spark, sf)
    return U.quality_gate(rows).select("execution_id", "article_id", "pos")


@query("dedup_title", sql(*NEWS, body="""
SELECT execution_id, title, min(pos) AS pos FROM articles WHERE title <> '' GROUP BY execution_id, title"""))
def dedup_title(spark, sf):
    rows = with_text(article_keys(spark, sf), spark, sf).select("execution_id", "title", "pos")
    return U.dedup_title(rows, ["execution_id"], [F.col("pos")])


@query("dedup_url", sql(*NEWS, body="SELECT url, min(pos) AS pos FROM articles GROUP BY url"))
def dedup_url(spark, sf):
    return U.dedup_url(article_keys(spark, sf), [], F.col("url"), [F.col("pos")]).select("url", "pos")


@query("dedup_url_quota", sql(*NEWS, _CANDIDATES_SQL, body="""
SELECT execution_id, article_id, pos, rank::INT AS rank FROM chosen"""))
def dedup_url_quota(spark, sf):
    return chosen(spark, sf).select("execution_id", "article_id", "pos", "rank")


@query("resume_skip", sql(*NEWS, body="""
SELECT execution_id, pos FROM articles a WHERE date >= '1998-01-01' AND NOT EXISTS (
  SELECT 1 FROM articles b WHERE b.date < '1998-01-01' AND b.execution_id = a.execution_id AND b.title = a.title)"""))
def resume_skip(spark, sf):
    """The run goes on after its earlier articles were stored."""
    rows = with_text(article_keys(spark, sf), spark, sf).select("execution_id", "title", "pos", "date")
    return U.skip_seen(rows.filter(F.col("date") >= "1998-01-01"), rows.filter(F.col("date") < "1998-01-01")).select(
        "execution_id", "pos")


@query("cache_replace", sql(*NEWS, body="""
SELECT url, max(pos) AS pos, arg_max(execution_id, pos) AS query, 0 AS ui_selected FROM articles GROUP BY url"""))
def cache_replace(spark, sf):
    rows = article_keys(spark, sf).select("url", "pos", F.col("execution_id").alias("query"))
    return U.cache_replace(rows, [F.col("pos").desc()])


@query("selection_rank", sql(*NEWS, _CANDIDATES_SQL, body="""
SELECT c.execution_id, c.url, c.pos, (CASE WHEN c.pos % 2 = 0 THEN 9 ELSE coalesce(s.rank, 0) END)::INT AS ui_selected FROM candidates c
LEFT JOIN chosen s ON s.execution_id = c.execution_id AND s.pos = c.pos"""))
def selection_rank(spark, sf):
    """Cache keys are address and run here: one address occurs in several runs. Rows at even places are of
    another query, whose selection stays."""
    key = F.concat_ws(" ", "execution_id", "pos")
    cache = article_keys(spark, sf).select(
        "execution_id", "pos", F.col("url").alias("_address"), key.alias("url"), F.lit(9).alias("ui_selected"),
        F.when(F.col("pos") % 2 == 0, "other").otherwise("asked").alias("query"))
    picks = chosen(spark, sf).select(key.alias("url"), "rank")
    return U.selection_rank(cache, picks, "asked").select(
        "execution_id", F.col("_address").alias("url"), "pos", "ui_selected")


@query("article_ids", sql(*NEWS, body="SELECT pos, md5(url) AS article_id, substring(md5(url), 1, 8) AS short_id FROM articles"))
def article_ids(spark, sf):
    return article_keys(spark, sf).select("pos", F.md5("url").alias("article_id"),
                                          F.substring(F.md5("url"), 1, 8).alias("short_id"))


@query("unresolved_urls", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'news.google.com' ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS host,
       page_id % 3 = 0 AS unresolved FROM pages""")
def unresolved_urls(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), "page_id")).otherwise(
        F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", F.parse_url(url, F.lit("HOST")).alias("host"), unresolved(url).alias("unresolved"))


@query("export_metadata", sql(*RUNS_NEWS, """
counts AS (SELECT execution_id, count(*) AS n FROM articles GROUP BY execution_id),
kinds AS (SELECT *, status = 'CANCELLED' AS bare FROM executions)""", body="""
SELECT execution_id, 'country' AS parameter, country AS value FROM kinds WHERE NOT bare
UNION ALL SELECT execution_id, 'query', search_term FROM kinds WHERE NOT bare
UNION ALL SELECT execution_id, 'qsite', '' FROM kinds WHERE NOT bare
UNION ALL SELECT execution_id, 'Fecha y Hora de Exportación', '2024-01-02 12:00:00' FROM kinds WHERE bare
UNION ALL SELECT execution_id, 'Total Artículos', CAST(coalesce(n, 0) AS VARCHAR) FROM kinds LEFT JOIN counts USING (execution_id)
  WHERE bare"""))
def export_metadata(spark, sf):
    """Cancelled runs are exported without parameters."""
    params = executions(spark, sf).select("execution_id", F.from_json(
        F.when(F.col("status") == "CANCELLED", "{}").otherwise(F.col("filters")), "map<string,string>").alias("params"))
    totals = article_keys(spark, sf).groupBy("execution_id").agg(F.count(F.lit(1)).alias("n"))
    return P.metadata_rows(params, totals, F.lit(NOW))


@query("export_json", sql(*NEWS, body="""
SELECT execution_id, article_id, '{"article_id":"' || article_id || '","url":"' || url || '","date":"' || date || '"' ||
   CASE WHEN source IS NULL THEN '' ELSE ',"source":"' || source || '"' END ||
   CASE WHEN places IS NULL THEN '' ELSE ',"places":' || geodata END || '}' AS article FROM articles"""))
def export_json(spark, sf):
    return P.article_json(articles(spark, sf), ["article_id", "url", "date", "source", "places"])


@query("export_payload", sql(ARTICLES_SQL, BATCHED[1], body="""
SELECT execution_id, batch_no, article_id, CASE WHEN batch_no % 3 = 1 THEN '' ELSE execution_id END AS origin FROM batched
WHERE batch_no % 3 <> 2
UNION ALL SELECT DISTINCT execution_id, batch_no, 'No articles to export', execution_id FROM batched WHERE batch_no % 3 = 2"""))
def export_payload(spark, sf):
    """Per batch an object with params, a bare list, or an object without articles."""
    item = F.struct("article_id", F.col("url").alias("title"))
    batches = batched_articles(spark, sf).groupBy("execution_id", "batch_no").agg(F.collect_list(item).alias("l"))
    listed, params = F.to_json("l"), F.concat(F.lit('{"run":"'), "execution_id", F.lit('"}'))
    kind = F.col("batch_no") % 3
    payload = (
        F.when(kind == 1, listed)
        .when(kind == 2, F.concat(F.lit('{"articles":[],"metadata":'), params, F.lit("}")))
        .otherwise(F.concat(F.lit('{"articles":'), listed, F.lit(',"params":'), params, F.lit("}"))))
    read = P.read_payloads(batches.select("execution_id", "batch_no", payload.alias("payload")))
    rows = read.select("execution_id", "batch_no", "params", "error", F.explode_outer("articles").alias("a"))
    return rows.select(
        "execution_id", "batch_no", F.coalesce("error", F.try_element_at("a", F.lit("article_id"))).alias("article_id"),
        F.coalesce(F.try_element_at("params", F.lit("run")), F.lit("")).alias("origin"))




@query("export_sheet", sql(*BATCHED, body="""
SELECT execution_id, batch_no, article_id, url, source, array_to_string(places, ',') AS places, pos::VARCHAR AS n
FROM (SELECT *, CASE WHEN places IS NULL THEN NULL ELSE places END AS p FROM batched) WHERE batch_no % 3 <> 2"""))
def export_sheet(spark, sf):
    """All fields of the articles of a download, each a column of the data set."""
    item = F.struct("article_id", "url", "source", "places", F.col("pos").alias("n"))
    batches = batched_articles(spark, sf).groupBy("execution_id", "batch_no").agg(F.to_json(F.collect_list(item)).alias("l"))
    bare = F.col("batch_no") % 3 == 1
    payload = F.when(bare, F.col("l")).when(F.col("batch_no") % 3 == 2, "{}").otherwise(F.concat(F.lit('{"articles":'), "l", F.lit("}")))
    read = P.read_payloads(batches.select("execution_id", "batch_no", payload.alias("payload")))
    sheet = P.payload_sheet(read, ["execution_id", "batch_no"], F.lit("now")).drop("Fecha de Extracción")
    return sheet.withColumn("places", F.array_join(F.from_json("places", "ARRAY<STRING>"), ","))


@query("export_run_files", sql(EXECUTIONS_SQL, *NEWS, body="""
SELECT execution_id, article_id, url, date, source, array_to_string(places, ',') AS places
FROM articles WHERE execution_id IN (SELECT execution_id FROM executions WHERE status = 'COMPLETED')"""))
def export_run_files(spark, sf):
    """Files of the completed runs, read back."""
    path = new_folder(spark, "export")
    chosen = executions(spark, sf).filter(F.col("status") == "COMPLETED")
    P.write_run_files(articles(spark, sf).select("execution_id", "article_id", "url", "date", "source", "places"), path, chosen)
    back = spark.read.schema("execution_id STRING, article_id STRING, url STRING, date STRING, source STRING, places ARRAY<STRING>").json(path)
    return back.withColumn("places", F.array_join("places", ","))
