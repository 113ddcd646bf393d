"""KPIs, top lists, timelines, filters and maps over the bound articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.dates import any_timestamp
from newsmart.functions.nested import hydrate_places
from newsmart.functions.text import word_count
from newsmart.operators import analytics as A
from newsmart.operators import regions as R
from newsmart.operators.history import aggregated_runs
from newsmart.operators.paging import read_page, write_directory
from newsmart.operators.retrieval import corpus_summary
from newsmart.plans.bindings import (
    NEWS, RUNS_NEWS, article_keys, articles, executions, pick, sql, table, with_text,
)
from newsmart.plans.catalog import query
from newsmart.sources.versions import new_folder

PICK = A.Selection(
    sources=("Supplier#000000001", "Supplier#000000002", "Supplier#000000003"),
    places=("NATION_1", "NATION_10", S.NO_PLACE),
    dates="1996-01-01 to 1999-12-31",
)
ONE_DAY = A.Selection(places=("NATION_1", "NATION_10", S.NO_PLACE), dates="1998-03-01")

_ALL = f"CASE WHEN len(coalesce(places, [])) > 0 THEN places ELSE ['{S.NO_PLACE}'] END"
_PICKED = "('NATION_1','NATION_10','Sin localidad')"
_PICK_SQL = f"""
  WHERE source IN ('Supplier#000000001','Supplier#000000002','Supplier#000000003')
    AND list_has_any({_ALL}, ['NATION_1','NATION_10','Sin localidad'])
    AND date >= '1996-01-01' AND date < '2000-01-01'"""
_DAY_SQL = f"""
  WHERE list_has_any({_ALL}, ['NATION_1','NATION_10','Sin localidad'])
    AND date >= '1998-03-01' AND date < '1998-03-02'"""


@query("top_states15", sql(*NEWS, body="""
SELECT place, count(*) AS n FROM (SELECT unnest(places) AS place FROM articles)
GROUP BY place ORDER BY n DESC, place LIMIT 15"""))
def top_states15(spark, sf):
    return A.most_frequent(articles(spark, sf), F.explode(hydrate_places(F.col("geodata"))), "place", 15)


@query("top_sources5", sql(*NEWS, body="""
SELECT source, count(*) AS n FROM articles GROUP BY source ORDER BY n DESC, source NULLS FIRST LIMIT 5"""))
def top_sources5(spark, sf):
    return A.most_frequent(articles(spark, sf), F.col("source"), "source", 5)


@query("corpus_summary", sql(*NEWS, body="""
SELECT count(*) AS total, count(*) FILTER (geodata <> '[]') AS with_geodata,
       coalesce(min(date), 'Unknown') AS first_date, coalesce(max(date), 'Unknown') AS last_date FROM articles"""))
def summary(spark, sf):
    return corpus_summary(articles(spark, sf))


def _kpi_sql(where: str, picked: bool) -> str:
    keep = f"WHERE place IN {_PICKED}" if picked else ""
    return sql(*NEWS, f"chosen AS (SELECT * FROM articles {where})",
               f"""by_place AS (SELECT place, count(*) AS n FROM (SELECT unnest({_ALL}) AS place FROM chosen)
                   {keep} GROUP BY place)""",
               "by_source AS (SELECT source, count(*) AS n FROM chosen WHERE source IS NOT NULL GROUP BY source)",
               body="""
SELECT (SELECT count(*) FROM chosen) AS total, (SELECT count(*) FROM by_place) AS coverage,
       coalesce((SELECT place FROM by_place ORDER BY n DESC, place LIMIT 1), '—') AS epicenter,
       coalesce((SELECT source FROM by_source ORDER BY n DESC, source LIMIT 1), '—') AS top_source""")


@query("kpis", _kpi_sql("", False))
def kpis(spark, sf):
    return A.kpis(articles(spark, sf))


@query("analytics_filter", _kpi_sql(_PICK_SQL, True))
def analytics_filter(spark, sf):
    """KPIs of a selection: sources, places and a date range."""
    return A.kpis(A.selected(articles(spark, sf), PICK), PICK)


@query("cross_filter", _kpi_sql("WHERE list_contains(coalesce(places, ['Sin localidad']), 'NATION_7')", False)
       .replace("GROUP BY place)", "WHERE place = 'NATION_7' GROUP BY place)"))
def cross_filter(spark, sf):
    """KPIs after three clicks: source on, source off, place on."""
    pick = A.Selection().toggle("source", "Supplier#000000004").toggle("source", "Supplier#000000004")
    pick = pick.toggle("state", "NATION_7")
    return A.kpis(A.selected(articles(spark, sf), pick), pick)


@query("feed_filter", sql(*NEWS, body=f"""
SELECT article_id, execution_id, date, source FROM articles {_PICK_SQL}"""))
def feed_filter(spark, sf):
    return A.selected(articles(spark, sf), PICK, single_day=False).select(
        "article_id", "execution_id", "date", "source")


@query("isolated_states", sql(*NEWS, body=f"""
SELECT place, count(*) AS n FROM (SELECT unnest({_ALL}) AS place FROM articles {_DAY_SQL})
WHERE place IN {_PICKED} GROUP BY place"""))
def isolated_states(spark, sf):
    """Places counted after a one-day selection: only the selected ones of each article."""
    chosen = A.selected(articles(spark, sf), ONE_DAY)
    return chosen.select(F.explode(A.counted_places(ONE_DAY)).alias("place")).groupBy("place").agg(
        F.count(F.lit(1)).alias("n"))


@query("facets", sql(*NEWS, body=f"""
SELECT 'place' AS kind, value, count(*) AS n FROM (SELECT unnest({_ALL}) AS value FROM articles) GROUP BY value
UNION ALL SELECT 'source', source, count(*) FROM articles WHERE source IS NOT NULL GROUP BY source"""))
def facets(spark, sf):
    return A.facets(articles(spark, sf))


def _top_sql(name: str, source: str) -> str:
    return sql(*NEWS, f"""head AS (SELECT {name}, count(*) AS n FROM ({source}) GROUP BY {name}
       ORDER BY n DESC, {name} LIMIT 10)""", body=f"""
SELECT {name}, n, 0.25::DOUBLE + n / greatest((SELECT max(n) FROM head), 1) * 0.75::DOUBLE AS intensity FROM head""")


@query("top_sources10", _top_sql("source", "SELECT source FROM articles WHERE source IS NOT NULL"))
def top_sources10(spark, sf):
    return A.top_sources(articles(spark, sf))


@query("top_states10", _top_sql("place", f"SELECT unnest({_ALL}) AS place FROM articles"))
def top_states10(spark, sf):
    return A.top_places(articles(spark, sf))


@query("timeline", sql(*NEWS, body="""
SELECT substring(date, 1, 10) AS day, count(*) AS n FROM articles GROUP BY day ORDER BY day"""))
def timeline(spark, sf):
    return A.timeline(article_keys(spark, sf))


@query("date_span", sql(*NEWS, body="""
SELECT strftime(min(CAST(date AS TIMESTAMP)), '%b %d, %Y') || ' - ' || strftime(max(CAST(date AS TIMESTAMP)), '%b %d, %Y')
       AS label FROM articles"""))
def date_span(spark, sf):
    return A.date_span(article_keys(spark, sf))


@query("distinct_dates", sql(*NEWS, body="SELECT DISTINCT date FROM articles"))
def distinct_dates(spark, sf):
    return article_keys(spark, sf).select("date").distinct()


@query("distinct_sources", sql(*NEWS, body="SELECT DISTINCT source FROM articles"))
def distinct_sources(spark, sf):
    return articles(spark, sf).select("source").distinct()


def region_table(spark, sf):
    """nation as the region list of one country, in key order."""
    return table(spark, sf, "nation").select(
        F.lit(S.DEFAULT_COUNTRY).alias("country"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("state_name"))


def _spelled(spark, sf):
    """Place names as writers spell them: exact, upper-cased with text around, or unknown to the list."""
    rows = articles(spark, sf).select("pos", F.explode("places").alias("p"))
    kind = F.col("pos") % 4
    place = (
        F.when(kind == 0, F.lower("p")).when(kind == 1, F.concat(F.lit("Zona "), F.upper("p"), F.lit(" Norte")))
        .when(kind == 2, F.replace("p", F.lit("NATION_"), F.lit("País ")))
        .otherwise(F.col("p"))
    )
    return rows.select(place.alias("place"))


_SPELLED_SQL = """
spelled AS (
  SELECT CASE pos % 4 WHEN 0 THEN lower(p) WHEN 1 THEN 'Zona ' || upper(p) || ' Norte'
                      WHEN 2 THEN replace(p, 'NATION_', 'País ') ELSE p END AS place
  FROM (SELECT pos, unnest(places) AS p FROM articles)),
named AS (SELECT place, count(*) AS n, trim(lower(strip_accents(place))) AS norm FROM spelled GROUP BY place),
matched AS (
  SELECT place, n, coalesce(
    (SELECT n_name FROM nation WHERE lower(n_name) = norm ORDER BY n_nationkey LIMIT 1),
    (SELECT n_name FROM nation WHERE contains(lower(n_name), norm) OR contains(norm, lower(n_name))
     ORDER BY n_nationkey LIMIT 1), place) AS region FROM named)"""


@query("region_match", sql(*NEWS, _SPELLED_SQL, body="SELECT place, region, n FROM matched"))
def region_match(spark, sf):
    names = _spelled(spark, sf).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    return R.match_regions(names, region_table(spark, sf)).select("place", "region", "n")


@query("choropleth", sql(*NEWS, """
per_region AS (SELECT p AS region, count(*) AS n FROM (SELECT unnest(places) AS p FROM articles) GROUP BY p)""",
                         body="""
SELECT region, n, (SELECT greatest(max(n), 1) FROM per_region) AS max_n,
       CASE WHEN n / (SELECT max(n) FROM per_region) >= 0.8 THEN '#174ea6'
            WHEN n / (SELECT max(n) FROM per_region) >= 0.6 THEN '#1a73e8'
            WHEN n / (SELECT max(n) FROM per_region) >= 0.4 THEN '#4285f4'
            WHEN n / (SELECT max(n) FROM per_region) >= 0.2 THEN '#8ab4f8' ELSE '#c6dafc' END AS colour
FROM per_region"""))
def choropleth(spark, sf):
    return R.choropleth(articles(spark, sf), region_table(spark, sf))


_CODES = list(S.US_STATES)
_STATES_SQL = "(VALUES " + ",".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(S.US_STATES.items())) + ") AS s(i, code, name)"

#: Documents as news of places: every third title names a nation, texts a nation in their middle and a state at their end, by
#: its postal code or its name.
_PLACED_SQL = f"""
names AS (
  SELECT n_name AS target, lower(n_name) AS word, false AS exact FROM nation
  UNION ALL SELECT name, lower(name), false FROM {_STATES_SQL} UNION ALL SELECT name, code, true FROM {_STATES_SQL}),
placed AS (
  SELECT doc_id, trim(split_part(text, '.', 1), ' ') || CASE WHEN doc_id % 3 = 0 THEN ': ' || a.n_name ELSE '' END AS title,
         substring(text, 1, length(text) // 2) || ' (' || b.n_name || ') ' || substring(text, length(text) // 2 + 1)
         || ', ' || CASE WHEN doc_id % 2 = 0 THEN code ELSE upper(name) END || '.' AS body
  FROM documents JOIN nation a ON a.n_nationkey = doc_id % 25 JOIN nation b ON b.n_nationkey = doc_id * 7 % 25
  JOIN {_STATES_SQL} ON i = doc_id % {len(_CODES)}),
worded AS (
  SELECT doc_id, ' ' || trim(regexp_replace(strip_accents(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS title,
         ' ' || trim(regexp_replace(strip_accents(body), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS body FROM placed),
tagged AS (
  SELECT doc_id, list_distinct(list(target) FILTER (WHERE contains(CASE WHEN exact THEN title ELSE lower(title) END, ' ' || word || ' '))) AS in_title,
         list_distinct(list(target) FILTER (WHERE contains(CASE WHEN exact THEN body ELSE lower(body) END, ' ' || word || ' '))) AS in_text
  FROM worded, names GROUP BY doc_id)"""


@query("tag_locations", sql(*NEWS, _PLACED_SQL, body="""
SELECT article_id, execution_id,
       coalesce(array_to_string(list_sort(CASE WHEN len(in_title) > 0 THEN in_title ELSE in_text END), ','), '') AS locations
FROM articles JOIN tagged ON doc_id = pos % (SELECT count(*) FROM documents)"""))
def tag_locations(spark, sf):
    """Every document is tagged once; its articles take over what was found."""
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    first, second = (nation.select(F.col("n_nationkey").alias(f"_k{i}"), F.col("n_name").alias(f"_n{i}")) for i in (1, 2))
    half = F.expr("char_length(text) div 2")
    code, name = pick(_CODES, F.col("doc_id") % len(_CODES)), pick([S.US_STATES[c] for c in _CODES], F.col("doc_id") % len(_CODES))
    placed = docs.join(first, F.col("doc_id") % 25 == F.col("_k1")).join(second, F.col("doc_id") * 7 % 25 == F.col("_k2")).select(
        "doc_id", F.concat(F.trim(F.substring_index("text", ".", 1)), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(": "), "_n1")).otherwise("")).alias("title"),
        F.concat(F.substring("text", F.lit(1), half), F.lit(" ("), "_n2", F.lit(") "), F.substring("text", half + 1, F.char_length("text")), F.lit(", "),
                 F.when(F.col("doc_id") % 2 == 0, code).otherwise(F.upper(name)), F.lit(".")).alias("body"))
    states = spark.createDataFrame([(S.DEFAULT_COUNTRY, 100 + i, n) for i, n in enumerate(S.US_STATES.values())], "country STRING, pos INT, state_name STRING")
    regions = region_table(spark, sf).unionByName(states)
    tagged = R.tag_locations(placed, regions, "doc_id", "title", "body", S.REGION_ALIASES, S.US_STATES)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    keys = article_keys(spark, sf).withColumn("doc_id", F.col("pos") % n_docs)
    return keys.join(tagged, "doc_id").select("article_id", "execution_id", F.array_join("locations", ",").alias("locations"))


@query("latest_two", sql(*NEWS, body="""
SELECT pos, article_id, execution_id FROM articles ORDER BY pos DESC LIMIT 2"""))
def latest_two(spark, sf):
    return A.latest_rows(article_keys(spark, sf)).select("pos", "article_id", "execution_id")


@query("page", sql(*NEWS, body="""
SELECT pos, article_id, 21::BIGINT AS page_start, 30::BIGINT AS page_end, (SELECT count(*) FROM articles) AS page_total
FROM articles ORDER BY pos DESC LIMIT 10 OFFSET 20"""))
def page(spark, sf):
    """Third page of the feed, newest first."""
    rows = article_keys(spark, sf).select("pos", "article_id")
    return A.page(rows, [F.col("pos").desc()], number=2, size=10, first=0)


@query("deep_page", sql("""
keys AS (SELECT min(o_orderkey) AS pos, md5('https://n.example/' || o_orderkey // 3) AS article_id FROM orders GROUP BY o_orderkey // 3, o_custkey),
spot AS (SELECT least(299, greatest(ceil(count(*) / 25)::BIGINT, 1) - 1) * 25 AS start, count(*) AS total FROM keys),
numbered AS (SELECT *, row_number() OVER (ORDER BY pos DESC) AS rn FROM keys)""", body="""
SELECT pos, article_id, start + 1 AS page_start, least(start + 25, total) AS page_end, total AS page_total
FROM numbered, spot WHERE rn > start AND rn <= start + 25"""))
def deep_page(spark, sf):
    """The 300th page of a table of 25 a page, newest first, found through the order directory."""
    path = new_folder(spark, "pages")
    write_directory(article_keys(spark, sf).select("pos", "article_id"), [("pos", True)], path, rows=2_000)
    return read_page(spark, path, 300, 25)


_MULTI = """
chosen AS (SELECT a.*, e.search_term AS origin_search_term, e.scraped_at FROM articles a JOIN executions e USING (execution_id)
           WHERE e.status = 'COMPLETED'),
multi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id
            ORDER BY scraped_at DESC NULLS LAST, execution_id) AS rn FROM chosen) WHERE rn = 1)"""


def _completed(spark, sf):
    return executions(spark, sf).filter(F.col("status") == "COMPLETED")


@query("multi_run", sql(*RUNS_NEWS, _MULTI, body="""
SELECT article_id, execution_id, date, source, origin_search_term FROM multi"""))
def multi_run(spark, sf):
    """Articles of all analyzed runs, each once."""
    return aggregated_runs(articles(spark, sf), _completed(spark, sf)).select(
        "article_id", "execution_id", "date", "source", "origin_search_term")


@query("hydrate_multi", sql(*RUNS_NEWS, _MULTI, body="""
SELECT article_id, substring(date, 1, 10) AS date, array_to_string(coalesce(places, []), '|') AS states,
       origin_search_term, image_url AS image FROM multi"""))
def hydrate_multi(spark, sf):
    rows = aggregated_runs(articles(spark, sf), _completed(spark, sf))
    return rows.select(
        "article_id", F.substring("date", 1, 10).alias("date"),
        F.array_join(hydrate_places(F.col("geodata")), "|").alias("states"), "origin_search_term",
        F.col("image_url").alias("image"))


@query("hydrate_run", sql(*NEWS, body="""
SELECT article_id, execution_id, CASE WHEN pos % 4 = 1 THEN '' WHEN pos % 4 = 2 THEN '' ELSE
   array_to_string(coalesce(places, []), '|') END AS states, image_url AS image FROM articles"""))
def hydrate_run(spark, sf):
    """Places out of whatever the geodata text holds: arrays, null, objects, broken text."""
    kind = F.col("pos") % 4
    text = (
        F.when(kind == 1, "null").when(kind == 2, F.concat(F.lit('{"a":'), F.col("geodata"), F.lit("}")))
        .otherwise(F.col("geodata"))
    )
    return articles(spark, sf).select(
        "article_id", "execution_id",
        F.array_join(hydrate_places(F.when(kind == 3, None).otherwise(text),
                                    F.when(kind == 3, F.col("geodata"))), "|").alias("states"),
        F.coalesce(F.when(F.col("image_url") != "", F.col("image_url"))).alias("image"))


@query("with_geodata", sql(*NEWS, body="SELECT article_id, execution_id FROM articles WHERE geodata <> '[]'"))
def with_geodata(spark, sf):
    return articles(spark, sf).filter(F.col("geodata") != "[]").select("article_id", "execution_id")


@query("ungeocoded", sql(*NEWS, body="SELECT article_id, execution_id FROM articles WHERE geodata IS NULL"))
def ungeocoded(spark, sf):
    return articles(spark, sf).filter(F.col("geodata").isNull()).select("article_id", "execution_id")


@query("text_measures", sql(*NEWS, body="""
SELECT article_id, execution_id, length(scraped_text) AS n_chars, length(content_snippet) AS snippet_chars,
       len(regexp_extract_all(scraped_text, '[^\\s]+'))::INT AS words,
       len(regexp_extract_all(content_snippet, '[^\\s]+'))::INT AS snippet_words FROM articles"""))
def text_measures(spark, sf):
    """Words of the whole text and of the stored snippet (the measure of the fact table)."""
    measured = with_text(
        article_keys(spark, sf), spark, sf,
        n_chars=F.length("scraped_text").cast("long"), snippet_chars=F.length("content_snippet").cast("long"),
        words=word_count(F.col("scraped_text")), snippet_words=word_count(F.col("content_snippet")),
    )
    return measured.select("article_id", "execution_id", "n_chars", "snippet_chars", "words", "snippet_words")


@query("located_runs", sql(*NEWS, body="""
SELECT execution_id, bool_or(len(coalesce(places, [])) > 0) AS has_geodata, bool_and(len(coalesce(places, [])) > 1) AS all_widely, min(CAST(date AS TIMESTAMP))::VARCHAR AS first_at
FROM articles GROUP BY execution_id"""))
def located_runs(spark, sf):
    """Per run: whether any article has places, whether all have several, and its first date."""
    at = F.date_format(F.min(any_timestamp(F.col("date"))), "yyyy-MM-dd HH:mm:ss")
    return articles(spark, sf).groupBy("execution_id").agg(
        F.bool_or(F.size(F.coalesce("places", F.array())) > 0).alias("has_geodata"),
        F.bool_and(F.size(F.coalesce("places", F.array())) > 1).alias("all_widely"), at.alias("first_at"))
