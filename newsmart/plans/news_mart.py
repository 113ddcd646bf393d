"""Enrichment, dead letters and the star schema over the bound articles and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.text import word_count
from newsmart.operators import enrich as E
from newsmart.operators import mart as M
from newsmart.operators import export as X
from newsmart.operators.regions import region_names
from newsmart.plans.bindings import (
    ANSWERED, BATCHED, EXECUTIONS_SQL, NEWS, RUNS_NEWS, article_keys, articles, batched_articles, executions,
    responses, settled_articles, sql, with_places, with_text, table,
)
from newsmart.plans.catalog import query
from newsmart.plans.news_analytics import region_table
from newsmart.sources.texts import Texts
from newsmart.sources.versions import durable

CUT = "1998-01-01"  # articles up to here were loaded earlier


def first_pass(spark, sf):
    """Articles with their batch answers."""
    return E.first_pass(responses(E.request_rows(batched_articles(spark, sf))))


def article_metrics(spark, sf, batched=None):
    """Settled articles with word counts; words are counted once per document."""
    done = settled_articles(spark, sf, batched).filter(F.col("outcome") != "dlq")
    counted = with_text(done, spark, sf, word_count=word_count(F.col("content_snippet")))
    return counted.withColumn("entity_count", F.size("entities_list"))


_METRICS_SQL = """
metrics AS (
  SELECT *, len(regexp_extract_all(content_snippet, '[^\\s]+'))::INT AS word_count, n_entities::INT AS entity_count
  FROM settled WHERE outcome <> 'dlq')"""

_SOURCES_SQL = f"""
old_source AS (
  SELECT row_number() OVER (ORDER BY substring(md5(source), 1, 3), source) AS source_id, source AS source_name
  FROM (SELECT DISTINCT source FROM articles WHERE date < '{CUT}' AND source IS NOT NULL)),
dim_source AS (
  SELECT source_id, source_name FROM old_source UNION ALL
  SELECT (SELECT coalesce(max(source_id), 0) FROM old_source)
         + row_number() OVER (ORDER BY substring(md5(source), 1, 3), source), source
  FROM (SELECT DISTINCT source FROM articles WHERE source IS NOT NULL
        AND source NOT IN (SELECT source_name FROM old_source)))"""

_FACT_SQL = """
fact AS (
  SELECT article_id, execution_id, CAST(substring(date, 1, 10) AS DATE) AS date_key, source_id,
         coalesce(m.word_count, 0) AS word_count, coalesce(m.entity_count, 0) AS entity_count,
         coalesce(m.sentiment_score, 0)::DECIMAL(5,2) AS sentiment_score
  FROM articles a LEFT JOIN dim_source d ON d.source_name = a.source
  LEFT JOIN (SELECT article_id, execution_id, word_count, entity_count, sentiment_score FROM metrics) m
  USING (article_id, execution_id))"""

MART = (*ANSWERED, _METRICS_SQL, _SOURCES_SQL, _FACT_SQL)


def empty(spark, ddl):
    return spark.createDataFrame([], ddl)


def dim_source_table(spark, sf, rows=None):
    """Two loads: sources seen before the cut, then all. Articles shrink to one row per source first."""
    rows = articles(spark, sf) if rows is None else rows
    rows = durable(rows.groupBy("source").agg(F.min("date").alias("date")))
    first = M.merge_dim_source(empty(spark, S.DIM_SOURCE), rows.filter(F.col("date") < CUT))
    return M.merge_dim_source(first, rows)


def dim_date_table(spark, sf, rows=None):
    rows = (article_keys(spark, sf) if rows is None else rows).select("date", "pos")
    first = M.merge_dim_date(empty(spark, S.DIM_DATE), rows.filter(F.col("date") < CUT))
    return M.merge_dim_date(first, rows)


def stored_batches(spark, sf):
    """The batched articles, written once for all that is read from them."""
    return durable(batched_articles(spark, sf).select("execution_id", "batch_no", "article_id", "pos", "date", "source", "places"))


def fact_and_sources(spark, sf, batched=None):
    """(fact, dim_source): a first load without measures, then the measures of all articles that got a result. Sources, first
    load and results are read from the stored batches."""
    batched = stored_batches(spark, sf) if batched is None else batched
    sources = durable(dim_source_table(spark, sf, batched))
    columns = ["article_id", "execution_id", "date", "source"]
    measures = ["word_count", "entity_count", "sentiment_score"]
    bare = batched.select(*columns, *[F.lit(None).alias(c) for c in measures])
    measured = article_metrics(spark, sf, batched).select(*columns, *measures)
    return M.upsert(M.fact_rows(bare, sources), M.fact_rows(measured, sources), M.KEYS), sources


def fact_table(spark, sf):
    return fact_and_sources(spark, sf)[0]


@query("batch_assign", sql(*BATCHED, body="SELECT article_id, execution_id, batch_no FROM batched"))
def batch_assign(spark, sf):
    return E.assign_batches(article_keys(spark, sf)).select("article_id", "execution_id", "batch_no")


@query("batch_payload", sql(*BATCHED, body="""
SELECT execution_id, batch_no, count(*) AS n_articles,
       string_agg(chr(10) || '----' || chr(10) || 'ARTICLE ID: ' || article_id || chr(10) ||
         CASE WHEN title <> '' THEN 'TITLE: ' || title || chr(10) ELSE '' END ||
         'TEXT: ' || content_snippet || chr(10), '' ORDER BY article_id) AS payload
FROM batched GROUP BY execution_id, batch_no"""))
def batch_payload(spark, sf):
    """A document's part of a request is made once, before it meets its articles, and parked until the payloads are made."""
    body, texts = E.article_body(F.col("title"), F.col("content_snippet")), Texts(spark)
    rows = with_text(E.assign_batches(article_keys(spark, sf)), spark, sf, body=body).select("execution_id", "batch_no", "article_id", "body")
    return E.batch_payload(texts.park(rows, ["body"]), body="body", texts=texts)


@query("responses_scan", sql(*ANSWERED, body=f"""
SELECT execution_id, batch_no, article_id,
       TRY_CAST(CASE pos % 20 WHEN 11 THEN 'abc' WHEN 13 THEN '0.5' ELSE
         CASE WHEN pos % 2 = 0 THEN '-' ELSE '' END || '0.' || lpad(CAST(pos % 100 AS VARCHAR), 2, '0') END AS DOUBLE)
         AS sentiment_score,
       CASE WHEN pos % 20 = 7 THEN NULL ELSE 'About ' || article_id END AS summary,
       (1 + len(coalesce(places, [])))::INT AS n_entities, array_to_string(coalesce(places, []), ',') AS locations
FROM answers WHERE pos % 20 <> 3 AND low % 13 <> 6 AND low % 11 <> 5"""))
def responses_scan(spark, sf):
    parsed = E.parse_answers(responses(E.request_rows(batched_articles(spark, sf))))
    return E.answer_rows(parsed, ["execution_id", "batch_no"]).select(
        "execution_id", "batch_no", "article_id", F.col("sentiment_score").try_cast("double").alias("sentiment_score"),
        "summary", F.size("entities_list").alias("n_entities"), F.array_join("locations_list", ",").alias("locations"))


@query("validate_metrics", sql(*ANSWERED, body="""
SELECT execution_id, article_id, CASE pos % 20 WHEN 7 THEN 'summary' WHEN 11 THEN 'sentiment_score' ELSE '' END AS problems,
       CASE WHEN pos % 20 = 11 THEN NULL WHEN pos % 20 = 13 THEN 0.5::DOUBLE ELSE
         CAST(CASE WHEN pos % 2 = 0 THEN '-' ELSE '' END || '0.' || lpad(CAST(pos % 100 AS VARCHAR), 2, '0') AS DOUBLE) END
         AS sentiment_score
FROM answers WHERE pos % 20 <> 3 AND low % 13 <> 6 AND low % 11 <> 5"""))
def validate_metrics(spark, sf):
    parsed = E.parse_answers(responses(E.request_rows(batched_articles(spark, sf))))
    checked = E.validate_metrics(E.answer_rows(parsed, ["execution_id", "batch_no"]))
    return checked.select("execution_id", "article_id", F.array_join("problems", ",").alias("problems"),
                          F.col("sentiment_score").cast("double").alias("sentiment_score"))


@query("retry_queue", sql(*ANSWERED, body="""
SELECT execution_id, article_id, CASE retry_reason WHEN 'missed' THEN 0 ELSE 1 END AS retry_order
FROM outcomes WHERE retry_reason IS NOT NULL"""))
def retry_queue(spark, sf):
    queue = E.retry_queue(first_pass(spark, sf))
    return queue.select("execution_id", "article_id", "retry_order")


DLQ_SQL = f"""
dlq AS (
  SELECT article_id, execution_id,
         CASE WHEN retry_reason IS NULL THEN coalesce(batch_raw, 'None') ELSE coalesce(retry_response, '') END AS raw_response,
         CASE WHEN low % 13 = 6 THEN 'model call failed' WHEN low % 11 = 5 THEN 'JSONDecodeError'
              WHEN pos % 7 = 0 THEN 'model call failed' WHEN pos % 7 = 1 THEN '{E.MISSED_AGAIN}'
              ELSE 'invalid: sentiment_score' END AS error_reason
  FROM outcomes WHERE outcome = 'dlq')"""
PASS_AT = "2024-01-01 00:00:00"
DLQ_BODY = f"SELECT *, '{PASS_AT}' AS \"timestamp\" FROM dlq"


def shown_time(rows):
    return rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("dlq_rows", sql(*ANSWERED, DLQ_SQL, body=DLQ_BODY))
def dlq_rows(spark, sf):
    return shown_time(E.dead_letters(settled_articles(spark, sf), F.lit(PASS_AT)))


@query("fact_update", sql(*MART, """
old_fact AS (SELECT * FROM fact WHERE date_key < DATE '1997-01-01'),
all_metrics AS (SELECT article_id, execution_id, word_count AS w, entity_count AS e, sentiment_score AS s FROM metrics)""", body="""
SELECT article_id, execution_id, coalesce(w, 1)::INT AS word_count, coalesce(e, 2)::INT AS entity_count,
       coalesce(s::DOUBLE, 3) AS sentiment_score
FROM old_fact LEFT JOIN all_metrics USING (article_id, execution_id)"""))
def fact_update(spark, sf):
    """Facts of some years take the measures of all results; results of other years add no facts."""
    batched = stored_batches(spark, sf)
    marks = {"word_count": F.lit(1), "entity_count": F.lit(2), "sentiment_score": F.lit(3).cast("decimal(5,2)")}
    fact = batched.filter(F.col("date") < "1997-01-01").select("article_id", "execution_id").withColumns(marks)
    done = E.fact_update(fact, article_metrics(spark, sf, batched))
    return done.withColumn("sentiment_score", F.col("sentiment_score").cast("double"))


@query("merge_metrics", sql(*ANSWERED, _METRICS_SQL, body="""
SELECT article_id, execution_id, date, source, outcome, sentiment_score::DOUBLE AS sentiment_score, word_count, entity_count,
       CASE outcome WHEN 'valid' THEN 'About ' ELSE 'Again ' END || article_id AS summary FROM metrics"""))
def merge_metrics(spark, sf):
    return article_metrics(spark, sf).select(
        "article_id", "execution_id", "date", "source", "outcome",
        F.col("sentiment_score").cast("double").alias("sentiment_score"), "word_count", "entity_count", "summary")


_ENTITIES_SQL = """
entity_rows AS (
  SELECT article_id, execution_id, coalesce(source, 'nobody') AS entity_text, 'ORGANIZATION' AS entity_type FROM metrics
  UNION ALL SELECT article_id, execution_id, unnest(places), 'LOCATION' FROM metrics)"""


@query("entity_rows", sql(*ANSWERED, _METRICS_SQL, _ENTITIES_SQL, body="SELECT * FROM entity_rows"))
def entity_rows(spark, sf):
    return E.entity_rows(settled_articles(spark, sf).filter(F.col("outcome") != "dlq"))


@query("dim_entities", sql(*ANSWERED, _METRICS_SQL, _ENTITIES_SQL, body="""
SELECT row_number() OVER (ORDER BY substring(md5(article_id || '|' || execution_id || '|' || entity_text || '|' || entity_type), 1, 3),
         article_id, execution_id, entity_text, entity_type) AS entity_id, *
FROM (SELECT DISTINCT * FROM entity_rows)"""))
def dim_entities(spark, sf):
    """Loaded twice: the second load adds nothing. The answers are read once for both."""
    rows = durable(E.entity_rows(settled_articles(spark, sf).filter(F.col("outcome") != "dlq")))
    return M.merge_entities(empty(spark, S.DIM_ENTITIES), rows.unionByName(rows))


@query("top_entities", sql(*ANSWERED, _METRICS_SQL, _ENTITIES_SQL, body="""
SELECT entity_text, entity_type, count(*) AS n FROM entity_rows GROUP BY ALL
ORDER BY n DESC, entity_text, entity_type LIMIT 10"""))
def top_entities(spark, sf):
    return M.top_entities(E.entity_rows(settled_articles(spark, sf).filter(F.col("outcome") != "dlq")))


@query("enrich_update", sql(*ANSWERED, body="""
SELECT article_id, execution_id, CASE WHEN outcome <> 'dlq' THEN
   CASE WHEN places IS NULL THEN '[]' ELSE geodata END END AS geodata FROM settled"""))
def enrich_update(spark, sf):
    """Articles start without places, as after a search run."""
    stored = article_keys(spark, sf).select("article_id", "execution_id", F.lit(None).cast("string").alias("geodata"))
    done = settled_articles(spark, sf).filter(F.col("outcome") != "dlq")
    return E.enrich_update(stored, done).select("article_id", "execution_id", "geodata")


@query("geodata_fallback", sql(*ANSWERED, body="""
SELECT article_id, execution_id, CASE WHEN outcome = 'dlq' AND retry_reason IS NULL THEN '[]' ELSE geodata END AS geodata
FROM outcomes"""))
def geodata_fallback(spark, sf):
    first = durable(first_pass(spark, sf).select("article_id", "execution_id", "state", "geodata"))
    return E.geodata_fallback(first, first.filter(F.col("state") == "failed")).select("article_id", "execution_id", "geodata")


@query("dim_date", sql(*NEWS, body="""
SELECT CAST(substring(date, 1, 10) AS DATE) AS date_key, arg_min(date, pos) AS date_str,
       any_value(CAST(substring(date, 1, 4) AS INT)) AS year, any_value(CAST(substring(date, 6, 2) AS INT)) AS month,
       any_value(CAST(substring(date, 9, 2) AS INT)) AS day FROM articles GROUP BY 1"""))
def dim_date(spark, sf):
    return dim_date_table(spark, sf)


@query("dim_source", sql(*NEWS, _SOURCES_SQL, body="SELECT * FROM dim_source"))
def dim_source(spark, sf):
    return dim_source_table(spark, sf)


@query("fact_upsert", sql(*MART, body="SELECT * REPLACE (sentiment_score::DOUBLE AS sentiment_score) FROM fact"))
def fact_upsert(spark, sf):
    return fact_table(spark, sf).withColumn("sentiment_score", F.col("sentiment_score").cast("double"))


@query("star_report", sql(*MART, body="""
SELECT year(date_key)::INT AS year, source_name, count(*) AS n_articles, sum(word_count)::BIGINT AS words,
       sum(entity_count)::BIGINT AS entities, sum(sentiment_score)::DOUBLE / count(*) AS avg_sentiment
FROM fact LEFT JOIN dim_source USING (source_id) GROUP BY 1, 2"""))
def star_report(spark, sf):
    batched = stored_batches(spark, sf)
    fact, sources = fact_and_sources(spark, sf, batched)
    return M.star_report(fact, dim_date_table(spark, sf, batched), sources, ["year", "source_name"])


@query("avg_sentiment", sql(*MART, body="""
SELECT date_key, count(*) AS n_articles, sum(sentiment_score)::DOUBLE / count(*) AS avg_sentiment FROM fact GROUP BY date_key"""))
def avg_sentiment(spark, sf):
    n = F.count(F.lit(1))
    return fact_table(spark, sf).groupBy("date_key").agg(
        n.alias("n_articles"), (F.sum("sentiment_score").cast("double") / n).alias("avg_sentiment"))


@query("delta_extract", sql(*NEWS, body=f"""
SELECT article_id, execution_id, title, url, date AS date_str, source AS source_name, content_snippet
FROM articles WHERE date >= '{CUT}' ORDER BY article_id, execution_id LIMIT 50"""))
def delta_extract(spark, sf):
    """Articles before the cut have facts. The fifty rows are found by their keys and then get the rest."""
    keys = article_keys(spark, sf)
    todo = M.next_articles(keys, keys.filter(F.col("date") < CUT))
    return M.delta_columns(with_text(with_places(todo, spark, sf), spark, sf))


_OLD_NEW = f"""
old AS (SELECT * FROM articles WHERE date < '2000-01-01'),
new AS (SELECT * FROM articles WHERE date >= '1996-01-01')"""


@query("articles_merge", sql(*NEWS, _OLD_NEW, body="""
SELECT coalesce(o.article_id, n.article_id) AS article_id, coalesce(o.execution_id, n.execution_id) AS execution_id,
       CASE WHEN o.pos IS NULL THEN 'Changed ' || n.title ELSE o.title END AS title,
       coalesce(o.url, n.url) AS url, coalesce(o.date, n.date) AS date,
       CASE WHEN o.pos IS NULL THEN n.source ELSE o.source END AS source, o.geodata,
       CASE WHEN n.pos IS NULL THEN o.image_url ELSE n.image_url || '?v=2' END AS image_url,
       coalesce(n.content_snippet, o.content_snippet) AS content_snippet
FROM old o FULL JOIN new n ON o.article_id = n.article_id AND o.execution_id = n.execution_id"""))
def articles_merge(spark, sf):
    """Two overlapping loads; the second one carries other titles (ignored) and images (taken)."""
    rows = with_text(durable(articles(spark, sf)), spark, sf)
    old = rows.filter(F.col("date") < "2000-01-01").select(
        *M.KEYS, "title", "url", "date", "source", "geodata", "image_url", "content_snippet")
    new = rows.filter(F.col("date") >= "1996-01-01").withColumns({
        "title": F.concat(F.lit("Changed "), "title"), "image_url": F.concat("image_url", F.lit("?v=2"))})
    return M.merge_articles(old, new)


@query("executions_merge", sql(EXECUTIONS_SQL, """
old AS (SELECT * FROM executions WHERE status <> 'CANCELLED'),
new AS (SELECT *, "timestamp" + INTERVAL 30 MINUTE AS done FROM executions WHERE status IN ('SCRAPING', 'CANCELLED'))""",
                               body="""
SELECT coalesce(o.execution_id, n.execution_id) AS execution_id, coalesce(o.search_term, n.search_term) AS search_term,
       coalesce(o.filters, n.filters) AS filters,
       CASE WHEN n.done IS NULL THEN o.status ELSE 'SCRAPED' END AS status,
       strftime(CASE WHEN n.done IS NULL THEN o.end_time ELSE n.done END, '%Y-%m-%d %H:%M:%S') AS end_time,
       strftime(CASE WHEN n.done IS NULL THEN o.scraped_at ELSE n.done END, '%Y-%m-%d %H:%M:%S') AS scraped_at
FROM old o FULL JOIN new n ON o.execution_id = n.execution_id"""))
def executions_merge(spark, sf):
    runs = executions(spark, sf)
    done = F.col("timestamp") + F.expr("interval 30 minutes")
    new = runs.filter(F.col("status").isin("SCRAPING", "CANCELLED")).withColumns(
        {"status": F.lit("SCRAPED"), "end_time": done, "scraped_at": done})
    merged = M.merge_executions(runs.filter(F.col("status") != "CANCELLED"), new)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return merged.select("execution_id", "search_term", "filters", "status", text("end_time"), text("scraped_at"))


@query("fk_audit", sql(*RUNS_NEWS, body="""
SELECT 'articles->executions' AS relation, count(*) AS orphans FROM articles
 WHERE execution_id NOT IN (SELECT execution_id FROM executions)
UNION ALL SELECT 'lines->suppliers', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'articles->completed runs', count(*) FROM articles
 WHERE execution_id NOT IN (SELECT execution_id FROM executions WHERE status = 'COMPLETED')"""))
def fk_audit(spark, sf):
    news, runs = article_keys(spark, sf), executions(spark, sf)
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return (
        M.orphans(news, runs, ["execution_id"], "articles->executions")
        .unionByName(M.orphans(lines, table(spark, sf, "supplier"), ["s_suppkey"], "lines->suppliers"))
        .unionByName(M.orphans(news, runs.filter(F.col("status") == "COMPLETED"), ["execution_id"],
                               "articles->completed runs"))
    )


@query("cascade_delete", sql(*RUNS_NEWS, body="""
SELECT article_id, execution_id FROM articles
WHERE execution_id NOT IN (SELECT execution_id FROM executions WHERE status = 'CANCELLED')"""))
def cascade_delete(spark, sf):
    gone = executions(spark, sf).filter(F.col("status") == "CANCELLED")
    return M.cascade_delete(article_keys(spark, sf), gone, ["execution_id"]).select("article_id", "execution_id")


@query("set_null", sql(*MART, body="""
SELECT article_id, execution_id, CASE WHEN source_id <= (SELECT max(source_id) FROM old_source) THEN source_id END AS source_id
FROM fact"""))
def set_null(spark, sf):
    """Facts after the sources of the second load were removed."""
    batched = stored_batches(spark, sf)
    kept = M.merge_dim_source(empty(spark, S.DIM_SOURCE),
                              batched.filter(F.col("date") < CUT).select("source"))
    return M.set_null(fact_and_sources(spark, sf, batched)[0], kept, "source_id").select("article_id", "execution_id", "source_id")


@query("funnel", sql(*ANSWERED, body="""
SELECT outcome AS stage, count(*) AS n FROM outcomes GROUP BY outcome
UNION ALL SELECT 'target', count(*) FROM outcomes
UNION ALL SELECT retry_reason, count(*) FROM outcomes WHERE retry_reason IS NOT NULL GROUP BY retry_reason"""))
def funnel(spark, sf):
    """Counters of an enrichment pass: target, missed, invalid, and the three outcomes, counted in one go."""
    stages = F.array(F.lit("target"), F.col("outcome"), F.when(F.col("state").isin(*E.QUEUED), F.col("state")))
    each = settled_articles(spark, sf).select(F.explode(F.array_compact(stages)).alias("stage"))
    return each.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("export_rows", sql(*ANSWERED, body="""
SELECT article_id, execution_id, coalesce(title, '') AS title, coalesce(source, '') AS source, url, date AS published,
       CASE WHEN len(coalesce(places, [])) > 0 THEN array_to_string(places, ', ') ELSE 'Sin localidad' END AS states,
       len(coalesce(places, [])) AS n_states,
       CASE WHEN outcome <> 'dlq' THEN array_to_string(list_concat([coalesce(source, 'nobody')], coalesce(places, [])), ', ')
            END AS entities,
       sentiment_score::DOUBLE AS sentiment, image_url AS image, 'all' AS origin_term FROM settled"""))
def export_rows(spark, sf):
    rows = with_text(settled_articles(spark, sf), spark, sf).withColumns(
        {"real_url": F.lit(""), "origin_search_term": F.lit("all")})
    return X.export_rows(rows)


_LEXICON_SQL = "len(list_filter(words, lambda w: w IN ({})))".format


def _in(words):
    return ",".join(f"'{w}'" for w in sorted(words))


@query("enrich_batches", sql(*BATCHED, f"""
worded AS (
  SELECT *, regexp_extract_all(lower(title || ' ' || content_snippet || ' ' || array_to_string(coalesce(places, []), ', ')),
         '[\\p{{L}}\\p{{N}}_]+') AS words FROM batched),
scored AS (SELECT *, {_LEXICON_SQL(_in(E.POSITIVE))} AS good, {_LEXICON_SQL(_in(E.NEGATIVE))} AS bad FROM worded)""", body="""
SELECT article_id, execution_id, 'valid' AS outcome,
       CAST(CAST(round((good - bad) / greatest(good + bad, 1), 2) AS VARCHAR) AS DECIMAL(5,2))::DOUBLE AS sentiment_score,
       array_to_string(coalesce(places, []), ',') AS locations FROM scored"""))
def enrich_batches(spark, sf):
    """The whole flow with the offline model, called once per batch of five in Arrow batches."""
    places = region_names(region_table(spark, sf))
    batched = with_text(batched_articles(spark, sf), spark, sf).select(
        "execution_id", "batch_no", "article_id", "title", "content_snippet", F.array_join("places", ", ").alias("place_names"))
    done = E.enrich(batched, E.lexicon_model(places), beside="place_names")
    return done.select(
        "article_id", "execution_id", "outcome", F.col("sentiment_score").cast("double").alias("sentiment_score"),
        F.array_join(F.array_sort("locations_list"), ",").alias("locations"))
