"""News tables as views over the TPC-H-like test tables, and the same views as SQL.

``executions`` come from customers, ``articles`` from orders (one article occurs in up to three runs),
model answers are composed from the articles with defects at fixed places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.operators.enrich import QUEUED, assign_batches, first_pass, request_rows, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def executions(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """customer -> runs, or one of them; filters is JSON text."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    cust = cust if run is None else cust.filter(F.col("c_custkey") == int(run))
    key = F.col("c_custkey")
    started = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, c_custkey)")
    later = lambda m: F.expr(f"_started + make_interval(0, 0, 0, 0, 0, {m})")
    status = pick(S.RUN_STATUSES, key % len(S.RUN_STATUSES))
    return (
        cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("_started", started)
        .withColumn("status", status)
        .select(
            key.cast("string").alias("execution_id"),
            F.col("_started").alias("timestamp"),
            F.col("c_mktsegment").alias("search_term"),
            F.concat(
                F.lit('{"country":"'), F.col("n_name"), F.lit('","query":"'), F.col("c_mktsegment"),
                F.lit('","qsite":""}'),
            ).alias("filters"),
            "status",
            F.when(F.col("status").isin(S.OPEN_ENDED_STATUSES), None)
            .otherwise(later("10 + c_custkey % 50")).alias("end_time"),
            F.when(key % 5 == 0, None).otherwise(later("10")).alias("scraped_at"),
        )
    )


def article_keys(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """orders -> one row per (article, run), the lowest order key first; of one run, found by its number in the scan."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders if run is None else orders.filter(F.col("o_custkey") == int(run))
    return (
        orders.groupBy(F.expr("o_orderkey div 3").alias("_no"), "o_custkey")
        .agg(F.min("o_orderkey").alias("pos"), F.min_by("o_orderdate", "o_orderkey").alias("_date"))
        .select(
            "pos",
            F.concat(F.lit("https://n.example/"), F.col("_no").cast("string")).alias("url"),
            F.col("o_custkey").cast("string").alias("execution_id"),
            F.date_format("_date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        )
        .withColumn("article_id", F.md5("url"))
    )


def article_places(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """lineitem -> source name and sorted place names per order, or of the orders in ``only`` (pos).

    Both shrink before the shuffle, in plain numbers: the lowest supplier key and the set of nation keys.
    Names are looked up afterwards."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    if only is not None:
        lines = lines.join(only.select(F.col("pos").alias("l_orderkey")), "l_orderkey", "left_semi")
    names = nation.agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("n")).scalar()
    per_order = (
        lines.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_orderkey").alias("pos"))
        .agg(F.min("l_suppkey").alias("_low"), F.collect_set("s_nationkey").alias("_keys"))
    )
    there = F.filter("_names", lambda n: F.array_contains("_keys", n["n_nationkey"]))
    return (
        per_order.join(supplier.select(F.col("s_suppkey").alias("_low"), F.col("s_name").alias("source")), "_low")
        .withColumn("_names", names)
        .select("pos", "source", there["n_name"].alias("places"))
    )


def with_places(keys: DataFrame, spark: SparkSession, sf_dir: str, few: bool = False) -> DataFrame:
    """``few``: the keys are few next to all lines, which are then cut to theirs before they are grouped."""
    return keys.join(article_places(spark, sf_dir, keys if few else None), "pos", "left").withColumns({
        "geodata": F.to_json("places"),
        "image_url": F.concat(F.lit("https://img.example/"), F.col("pos").cast("string"), F.lit(".jpg")),
    })


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without their text: keys, address, date, source, places (array) and geodata (JSON text)."""
    return with_places(article_keys(spark, sf_dir), spark, sf_dir)


def with_text(articles_: DataFrame, spark: SparkSession, sf_dir: str, **derived: Column) -> DataFrame:
    """Adds title, whole text and the stored snippet from documents. ``derived`` columns are computed once
    per document (from title, scraped_text, content_snippet) before the text meets its many articles; the
    shuffle by doc_id that the join needs comes first, so that work runs on all cores even for one file.
    Columns nobody asks for are cut before that shuffle."""
    docs = table(spark, sf_dir, "documents")
    text = docs.select(
        F.col("doc_id").alias("_doc"),
        F.trim(F.substring_index("text", ".", 1)).alias("title"),
        F.col("text").alias("scraped_text"),
        F.substring("text", 1, S.SNIPPET_CHARS).alias("content_snippet"),
    ).repartition("_doc")
    text = text.withColumns(derived) if derived else text
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return articles_.withColumn("_doc", F.col("pos") % n_docs).join(text, "_doc", "left").drop("_doc")


def full_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(articles(spark, sf_dir), spark, sf_dir)


def batched_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_places(assign_batches(article_keys(spark, sf_dir)), spark, sf_dir)


def _answer(of, sentiment: Column, summary: Column) -> Column:
    """JSON text of one result; ``of`` gives a field of the article."""
    entity = lambda text, kind: F.concat(
        F.lit('{"entity_text":"'), text, F.lit(f'","entity_type":"{kind}"}}')
    )
    places = F.coalesce(of("places"), F.array())
    entities = F.concat(
        F.array(entity(F.coalesce(of("source"), F.lit("nobody")), "ORGANIZATION")),
        F.transform(places, lambda p: entity(p, "LOCATION")),
    )
    quoted = F.transform(places, lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    return F.concat(
        F.lit('{"article_id":"'), of("article_id"), F.lit('","sentiment_score":'), sentiment, summary,
        F.lit(',"entities_list":['), F.array_join(entities, ","),
        F.lit('],"locations_list":['), F.array_join(quoted, ","), F.lit("]}"),
    )


def _plain_sentiment(pos: Column) -> Column:
    return F.concat(
        F.when(pos % 2 == 0, "-").otherwise(""), F.lit("0."),
        F.lpad((pos % 100).cast("string"), 2, "0"),
    )


def responses(requests: DataFrame) -> DataFrame:
    """Requests with one raw model answer each. By pos % 20: 3 leaves the article out, 7 leaves the summary out,
    11 gives a sentiment that is no number, 13 a number as text. By the lowest pos of the batch: % 11 = 5
    cuts the JSON short, % 13 = 6 is a failed call."""

    def answer(a: Column) -> Column:
        pos = a["pos"]
        sentiment = F.when(pos % 20 == 11, '"abc"').when(pos % 20 == 13, '"0.5"').otherwise(_plain_sentiment(pos))
        summary = F.when(pos % 20 == 7, "").otherwise(F.concat(F.lit(',"summary":"About '), a["article_id"], F.lit('"')))
        return F.when(pos % 20 != 3, _answer(lambda f: a[f], sentiment, summary))

    whole = F.concat(F.lit('{"results":['), F.array_join(F.transform("articles", answer), ","), F.lit("]}"))
    low = F.array_min(F.col("articles")["pos"])
    return requests.withColumns({"_whole": whole, "_low": low}).select(
        *requests.columns,
        F.when(F.col("_low") % 13 == 6, None).when(F.col("_low") % 11 == 5, F.expr("left(_whole, length(_whole) - 7)"))
        .otherwise(F.col("_whole")).alias("raw_response"),
        F.when(F.col("_low") % 13 == 6, "model call failed").alias("call_error"),
    )


def retry_responses(first: DataFrame) -> DataFrame:
    """First-pass rows with one raw answer per queued article. By pos % 7: 0 is a failed call, 1 leaves the article out
    again, 2 is invalid again, the rest is fine."""
    kind, queued = F.col("pos") % 7, F.col("state").isin(*QUEUED)
    sentiment = F.when(kind == 2, '"abc"').otherwise(_plain_sentiment(F.col("pos")))
    summary = F.concat(F.lit(',"summary":"Again '), F.col("article_id"), F.lit('"'))
    answer = F.when(kind == 1, "").otherwise(_answer(F.col, sentiment, summary))
    return first.withColumns({
        "retry_response": F.when(queued & (kind != 0), F.concat(F.lit('{"results":['), answer, F.lit("]}"))),
        "retry_error": F.when(queued & (kind == 0), "model call failed"),
    })


def settled_articles(spark: SparkSession, sf_dir: str, batched: DataFrame | None = None) -> DataFrame:
    """Batched articles with the outcome of both passes. From the batches on no row moves."""
    requests = request_rows(batched_articles(spark, sf_dir) if batched is None else batched)
    return settle(retry_responses(first_pass(responses(requests))))


# --- the same views in SQL -------------------------------------------------------------------

_STATUS_SQL = "[" + ",".join(f"'{s}'" for s in S.RUN_STATUSES) + "]"
_OPEN_SQL = "(" + ",".join(f"'{s}'" for s in S.OPEN_ENDED_STATUSES) + ")"

EXECUTIONS_SQL = f"""
executions AS (
  SELECT CAST(c_custkey AS VARCHAR) AS execution_id,
         TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS "timestamp",
         c_mktsegment AS search_term,
         '{{"country":"' || n_name || '","query":"' || c_mktsegment || '","qsite":""}}' AS filters,
         n_name AS country,
         status,
         CASE WHEN status IN {_OPEN_SQL} THEN NULL
              ELSE TIMESTAMP '2024-01-01' + to_minutes(c_custkey + 10 + c_custkey % 50) END AS end_time,
         CASE WHEN c_custkey % 5 = 0 THEN NULL
              ELSE TIMESTAMP '2024-01-01' + to_minutes(c_custkey + 10) END AS scraped_at
  FROM (SELECT *, {_STATUS_SQL}[CAST(c_custkey % 8 AS INT) + 1] AS status FROM customer)
  JOIN nation ON c_nationkey = n_nationkey)"""

ARTICLES_SQL = f"""
article_keys AS (
  SELECT min(o_orderkey) AS pos, arg_min(o_orderdate, o_orderkey) AS odate, o_orderkey // 3 AS no, o_custkey
  FROM orders GROUP BY o_orderkey // 3, o_custkey),
article_places AS (
  SELECT l_orderkey, arg_min(s_name, l_suppkey) AS source, list_sort(list(DISTINCT n_name)) AS places
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY l_orderkey),
articles AS (
  SELECT pos, md5('https://n.example/' || no) AS article_id, CAST(o_custkey AS VARCHAR) AS execution_id,
         'https://n.example/' || no AS url, strftime(odate, '%Y-%m-%d %H:%M:%S') AS date, article_places.source AS source, places,
         '["' || array_to_string(places, '","') || '"]' AS geodata,
         'https://img.example/' || pos || '.jpg' AS image_url,
         trim(split_part(text, '.', 1), ' ') AS title, text AS scraped_text,
         substring(text, 1, {S.SNIPPET_CHARS}) AS content_snippet
  FROM article_keys
  LEFT JOIN article_places ON l_orderkey = pos
  LEFT JOIN documents ON doc_id = pos % (SELECT count(*) FROM documents))"""

BATCHED_SQL = """
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY execution_id ORDER BY article_id) - 1) // 5 AS batch_no
  FROM articles)"""

_SENTIMENT_SQL = "(CASE WHEN pos % 2 = 0 THEN '-' ELSE '' END || '0.' || lpad(CAST(pos % 100 AS VARCHAR), 2, '0'))"
_TAIL_SQL = """
  ',"entities_list":[' || array_to_string(list_concat(
     ['{"entity_text":"' || coalesce(source, 'nobody') || '","entity_type":"ORGANIZATION"}'],
     list_transform(coalesce(places, []), lambda p: '{"entity_text":"' || p || '","entity_type":"LOCATION"}')), ',')
  || '],"locations_list":[' || array_to_string(list_transform(coalesce(places, []), lambda p: '"' || p || '"'), ',')
  || ']}'"""

RESPONSES_SQL = f"""
answers AS (
  SELECT *, CASE WHEN pos % 20 <> 3 THEN
     '{{"article_id":"' || article_id || '","sentiment_score":' ||
     CASE pos % 20 WHEN 11 THEN '"abc"' WHEN 13 THEN '"0.5"' ELSE {_SENTIMENT_SQL} END ||
     CASE WHEN pos % 20 = 7 THEN '' ELSE ',"summary":"About ' || article_id || '"' END || {_TAIL_SQL} END AS answer,
     min(pos) OVER (PARTITION BY execution_id, batch_no) AS low
  FROM batched),
whole_responses AS (
  SELECT execution_id, batch_no, min(low) AS low,
         '{{"results":[' || coalesce(string_agg(answer, ',' ORDER BY article_id), '') || ']}}' AS whole
  FROM answers GROUP BY execution_id, batch_no),
responses AS (
  SELECT execution_id, batch_no, low,
         CASE WHEN low % 13 = 6 THEN NULL WHEN low % 11 = 5 THEN substring(whole, 1, length(whole) - 7)
              ELSE whole END AS raw_response,
         CASE WHEN low % 13 = 6 THEN 'model call failed' END AS call_error
  FROM whole_responses),
retry_raw AS (
  SELECT execution_id, article_id,
         CASE WHEN pos % 7 = 0 THEN NULL ELSE '{{"results":[' || CASE WHEN pos % 7 = 1 THEN '' ELSE
           '{{"article_id":"' || article_id || '","sentiment_score":' ||
           CASE WHEN pos % 7 = 2 THEN '"abc"' ELSE {_SENTIMENT_SQL} END ||
           ',"summary":"Again ' || article_id || '"' || {_TAIL_SQL} END || ']}}' END AS raw_response
  FROM answers),
outcomes AS (
  SELECT a.*, r.raw_response AS batch_raw,
         CASE WHEN a.low % 13 = 6 THEN 'dlq' WHEN a.low % 11 = 5 THEN 'dlq'
              WHEN pos % 20 NOT IN (3, 7, 11) THEN 'valid'
              WHEN pos % 7 IN (0, 1, 2) THEN 'dlq' ELSE 'recovered' END AS outcome,
         CASE WHEN a.low % 13 = 6 OR a.low % 11 = 5 THEN NULL WHEN pos % 20 = 3 THEN 'missed'
              WHEN pos % 20 IN (7, 11) THEN 'invalid' END AS retry_reason,
         q.raw_response AS retry_response
  FROM answers a JOIN responses r USING (execution_id, batch_no) JOIN retry_raw q USING (execution_id, article_id)),
settled AS (
  SELECT *, CASE outcome WHEN 'dlq' THEN NULL ELSE
      CAST(CASE WHEN outcome = 'valid' AND pos % 20 = 13 THEN '0.5' ELSE {_SENTIMENT_SQL} END AS DECIMAL(5,2)) END
      AS sentiment_score,
      CASE outcome WHEN 'dlq' THEN NULL ELSE 1 + len(coalesce(places, [])) END AS n_entities
  FROM outcomes)"""


def sql(*ctes: str, body: str) -> str:
    """WITH the named views in front of a SELECT."""
    return "WITH " + ",".join(ctes) + "\n" + body


RUNS = (EXECUTIONS_SQL,)
NEWS = (ARTICLES_SQL,)
RUNS_NEWS = (EXECUTIONS_SQL, ARTICLES_SQL)
BATCHED = (ARTICLES_SQL, BATCHED_SQL)
ANSWERED = (ARTICLES_SQL, BATCHED_SQL, RESPONSES_SQL)
