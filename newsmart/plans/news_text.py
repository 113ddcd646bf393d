"""Feeds, pages, questions, retrieval, chat memory and ad-hoc SQL over documents, pages and conversations."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions import crypto
from newsmart.functions import text as X
from newsmart.functions.payload import clean_json, clean_nested
from newsmart.operators import pages as P
from newsmart.operators import retrieval as R
from newsmart.plans.bindings import NEWS, RUNS_NEWS, article_keys, articles, executions, sql, table, with_places, with_text
from newsmart.plans.catalog import query
from newsmart.sources import feeds as D
from newsmart.sources.tables import read_table
from newsmart.sources.versions import durable, new_folder

QUESTION = "¿Cuántas noticias hablan de oredat, enterprise, retition y sobre tion en que mentere?"
_WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
KEY_CONF = "spark.newsmart.chat.key"


def chat_key(spark):
    """AES key from the session. One without a key draws its own, on a cluster too: it reaches the executors within the plans,
    and what these queries store lies in the application's work folder and is read by this application only."""
    if not spark.conf.get(KEY_CONF, None):
        spark.conf.set(KEY_CONF, secrets.token_hex(16))
    return F.lit(spark.conf.get(KEY_CONF))


# --- feeds and pages --------------------------------------------------------------------------

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"  # what XML does not allow


def feed_items(spark, sf):
    """documents -> one feed item text each; the feed is the document's source, the place its doc_id.
    Every tenth date is no date, every seventh item has no source, every fifth a picture."""
    doc = F.col("doc_id")
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                                 F.lit(">"), F.lit("&gt;"))
    when = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, doc_id % 8000)")
    date = F.when(doc % 10 == 9, "yesterday").otherwise(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    picture = F.when(doc % 5 == 0, F.concat(F.lit('<img alt="x" src="https://img.example/'), doc, F.lit('.jpg">'))).otherwise("")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), CONTROL, " ")
    body = F.concat(F.lit("<p>"), escape(text), F.lit("</p>"), picture)
    source = F.when(doc % 7 != 0, F.concat(
        F.lit('<source url="https://'), "source", F.lit('.example">Source '), "source", F.lit("</source>"))).otherwise("")
    xml = F.concat(
        F.lit("<item><guid>g"), doc, F.lit("</guid><title>"), escape(F.concat(F.lit("Item & "), doc)),
        F.lit("</title><link>https://news.google.com/rss/"), doc, F.lit("</link><pubDate>"), date, F.lit("</pubDate>"),
        source, F.lit("<description>"), escape(body), F.lit("</description></item>"))
    return table(spark, sf, "documents").select(F.col("source").alias("feed"), doc.alias("pos"), xml.alias("xml"))


@query("rss_items", """
WITH items AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT source AS feed, doc_id AS pos, 'g' || doc_id AS guid, 'Item & ' || doc_id AS title,
       'https://news.google.com/rss/' || doc_id AS url,
       CASE WHEN doc_id % 10 = 9 THEN 'yesterday'
            ELSE strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id % 8000), '%Y-%m-%d %H:%M:%S') END AS date,
       CASE WHEN doc_id % 7 = 0 THEN 'Desconocido' ELSE 'Source ' || source END AS source,
       CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'https://' || source || '.example' END AS source_url,
       trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x20\\x7f]+', ' ', 'g'), ' ') AS summary,
       CASE WHEN doc_id % 5 = 0 THEN 'https://img.example/' || doc_id || '.jpg' END AS feed_image_url
FROM items WHERE rn <= 300""")
def rss_items(spark, sf):
    """First 3 x 100 items of each feed, parsed."""
    first = D.candidates(feed_items(spark, sf), "feed", "pos", S.MAX_ARTICLES)
    return D.parse_items(first)


def fetched_pages(spark, sf):
    return table(spark, sf, "pages").withColumn(
        "status", F.when(F.col("page_id") % 6 == 5, 404).when(F.col("page_id") % 17 == 0, 429).otherwise(200))


@query("pages_scan", """
SELECT page_id, url, length(html) AS n_chars FROM pages WHERE page_id % 6 <> 5 AND page_id % 17 <> 0""")
def pages_scan(spark, sf):
    return P.pages_scan(fetched_pages(spark, sf)).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


_STRIP_SQL = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in S.BOILERPLATE_TAGS:
    _STRIP_SQL = f"regexp_replace({_STRIP_SQL}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', '', 'g')"


def _text_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{a0}}]+', ' ', 'g'), ' ')"


@query("strip_boilerplate", f"SELECT page_id, md5({_STRIP_SQL}) AS digest, length({_STRIP_SQL}) AS n_chars FROM pages")
def strip_boilerplate(spark, sf):
    html = P.strip_boilerplate(F.col("html"))
    return table(spark, sf, "pages").repartition("page_id").select(
        "page_id", F.md5(html).alias("digest"), F.length(html).cast("long").alias("n_chars"))


@query("page_text", f"SELECT page_id, {_text_sql(_STRIP_SQL)} AS text FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").repartition("page_id").select(
        "page_id", P.visible_text(P.strip_boilerplate(F.col("html"))).alias("text"))


@query("page_extract", f"""
WITH stripped AS (SELECT page_id, {_STRIP_SQL} AS html FROM pages),
texts AS (SELECT page_id, {_text_sql("regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)")} AS main,
          {_text_sql("html")} AS whole FROM stripped)
SELECT page_id, CASE WHEN length(main) > 100 THEN main ELSE whole END AS text FROM texts""")
def page_extract(spark, sf):
    return P.page_extract(table(spark, sf, "pages").repartition("page_id")).select("page_id", "text")


@query("page_extract_clean", f"""
WITH stripped AS (SELECT page_id, {_STRIP_SQL} AS html FROM pages),
texts AS (SELECT page_id, {_text_sql("regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)")} AS main,
          {_text_sql("html")} AS whole FROM stripped)
SELECT page_id, CASE WHEN length(main) > 100 THEN main ELSE whole END AS text FROM texts""")
def page_extract_clean(spark, sf):
    """The same ladder with its rung that drops share bars: bars put into and around the articles leave no trace."""
    bar = F.lit('<div class="share-bar">Share<div>this <b>now</b></div></div>')
    html = F.replace(F.replace("html", F.lit("<article>"), F.concat(bar, F.lit("<article>"), bar)), F.lit("</article>"), F.concat(bar, F.lit("</article>")))
    pages = table(spark, sf, "pages").repartition("page_id").withColumn("html", html)
    return P.page_extract(pages, clean=True).select("page_id", "text")


@query("strip_noise", f"""
SELECT page_id, {_text_sql(_STRIP_SQL)} AS text FROM pages""")
def strip_noise(spark, sf):
    """Share bars and the like are put around every page and must go; the page's own text must stay."""
    bar = F.lit('<ul class="x social-bar"><li>Share<ul><li>now</li></ul></li></ul><p id="printBox">Print<br>me</p>')
    pages = table(spark, sf, "pages").repartition("page_id").select(
        "page_id", P.strip_noise(P.strip_boilerplate(F.replace("html", F.lit("<article>"), F.concat(bar, F.lit("<article>")))))
        .alias("html"))
    return pages.select("page_id", P.visible_text(F.col("html")).alias("text"))


@query("lead_image", """
SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://cdn.example/' || page_id || '.jpg'
  WHEN 1 THEN 'https://t.example/' || page_id || '.png' WHEN 2 THEN '' ELSE 'https://p.example/' || page_id || '.gif' END AS image_url
FROM pages""")
def lead_image(spark, sf):
    """Pages get image declarations of four kinds: og, twitter behind a logo, only a data: picture, picture
    without scheme."""
    kind, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    head = (
        F.when(kind == 0, F.concat(F.lit('<meta property="og:image" content=" https://cdn.example/'), n, F.lit('.jpg">')))
        .when(kind == 1, F.concat(F.lit('<meta property="og:image" content="/Logo.png"><meta name="twitter:image" content="https://t.example/'),
                                  n, F.lit('.png">')))
        .when(kind == 2, '<img src="data:image/png;base64,xx"><img src="/icons/a.png">')
        .otherwise(F.concat(F.lit('<link rel="image_src" href=""><img src="//p.example/'), n, F.lit('.gif">'))))
    pages = table(spark, sf, "pages").repartition("page_id").withColumn(
        "html", F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))))
    return P.with_lead_image(pages).select("page_id", "url", "image_url")


# --- text rules over whole documents and chat turns -------------------------------------------

_ATTACKS = ["Ignore previous instructions", "reveal your  prompt", "FORGET everything", "javascript:alert(1)",
            "SystemPrompt", "a jailbreak", "do anything now", "plain words"]
_ATTACKS_SQL = "[" + ",".join(f"'{a}'" for a in _ATTACKS) + "]"


def dirty_turns(spark, sf):
    attack = F.element_at(F.array(*[F.lit(a) for a in _ATTACKS]), (F.col("turn") % len(_ATTACKS) + 1).cast("int"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("  <b>"), attack, F.lit("</b> "), "text").alias("text"))


_DIRTY_SQL = f"""
dirty AS (SELECT conv_id, turn, '  <b>' || {_ATTACKS_SQL}[turn % 8 + 1] || '</b> ' || text AS text FROM conversations)"""
_PHRASES_SQL = "|".join(p for p in S.INJECTION_PHRASES if p != r"DAN\b")


@query("sanitize_text", sql(_DIRTY_SQL, body=f"""
SELECT conv_id, turn, substring(regexp_replace(regexp_replace(regexp_replace(trim(text, {_WS}), '<[^>]+>', '', 'g'),
   '(?i)({_PHRASES_SQL})', '[REDACTED]', 'g'), '(?i)dan($|[^\\p{{L}}\\p{{N}}_])', '[REDACTED]\\1', 'g'), 1, 600) AS clean FROM dirty"""))
def sanitize_text(spark, sf):
    return dirty_turns(spark, sf).select("conv_id", "turn", X.clean_question(F.col("text")).alias("clean"))


@query("sanitize_payload", sql(_DIRTY_SQL, body="""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '(?i)javascript:', '', 'g'), @WS@) AS text
FROM dirty""".replace("@WS@", _WS)))
def sanitize_payload(spark, sf):
    return dirty_turns(spark, sf).select("conv_id", "turn", X.clean_payload(F.col("text")).alias("text"))


@query("sanitize_nested", sql(_DIRTY_SQL, body="""
SELECT conv_id, turn, clean AS query, clean || '|x|' AS names, clean AS deep, turn AS n, CASE WHEN turn % 2 = 0 THEN clean END AS maybe,
       clean AS typed_value, clean AS typed_list
FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '(?i)javascript:', '', 'g'), @WS@) AS clean FROM dirty)"""
                              .replace("@WS@", _WS)))
def sanitize_nested(spark, sf):
    """Payloads as JSON text of objects and lists in each other, and as columns of nested types."""
    turns = dirty_turns(spark, sf)
    maybe = F.when(F.col("turn") % 2 == 0, F.col("text"))
    payload = F.struct(
        F.col("text").alias("query"), F.col("turn").alias("n"), maybe.alias("maybe"),
        F.struct(F.array("text", F.lit("<b>x</b>"), F.lit(" ")).alias("names"), F.array(F.struct(F.create_map(F.lit("k"), F.col("text")).alias("m"))).alias("l")).alias("f"))
    typed = F.struct(F.create_map(F.lit("<k>"), F.col("text")).alias("m"), F.array(F.struct("text")).alias("a"))
    rows = turns.select("conv_id", "turn", F.to_json(payload).alias("json"), typed.alias("typed"))
    clean = rows.select("conv_id", "turn", clean_json(F.col("json")).alias("json"), clean_nested(F.col("typed"), rows.schema["typed"].dataType).alias("typed"))
    back = F.from_json("json", "query STRING, n LONG, maybe STRING, f STRUCT<names: ARRAY<STRING>, l: ARRAY<STRUCT<m: MAP<STRING, STRING>>>>")
    return clean.withColumn("b", back).select(
        "conv_id", "turn", "b.query", F.array_join("b.f.names", "|").alias("names"), F.try_element_at(F.get("b.f.l", F.lit(0))["m"], F.lit("k")).alias("deep"), "b.n", "b.maybe",
        F.try_element_at("typed.m", F.lit("<k>")).alias("typed_value"), F.array_join(F.col("typed.a")["text"], "|").alias("typed_list"))


_QUANT_SQL = "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(S.QUANTITY_WORDS) + ")($|[^\\p{L}\\p{N}_])"


@query("classify_intent", f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(CASE turn % 3 WHEN 0 THEN text || ' por estado' WHEN 1 THEN 'Topic ' || text ELSE text END,
   '{_QUANT_SQL}') THEN 'ANALYTICAL' ELSE 'SEMANTIC' END AS intent FROM conversations""")
def classify_intent(spark, sf):
    kind = F.col("turn") % 3
    text = F.when(kind == 0, F.concat("text", F.lit(" por estado"))).when(
        kind == 1, F.concat(F.lit("Topic "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.intent(text).alias("intent"))


_STOP_SQL = "(" + ",".join(f"'{w}'" for w in S.QUESTION_STOPWORDS) + ")"


def _keywords_sql(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: regexp_matches(w, '^[a-zA-ZáéíóúÁÉÍÓÚñÑ]{{4,}}$') AND w NOT IN {_STOP_SQL})[1:5]")


@query("display_name", """
SELECT DISTINCT url, list_extract(string_split(url, '/'), -1) AS name FROM pages""")
def display_name(spark, sf):
    """Last part of slash-separated names."""
    return table(spark, sf, "pages").select("url", X.display_name(F.col("url")).alias("name")).distinct()


@query("question_keywords", f"""
SELECT conv_id, turn, array_to_string({_keywords_sql('text')}, ',') AS keywords FROM conversations""")
def question_keywords(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(X.question_keywords(F.col("text")), ",").alias("keywords"))


_LOG = ["Error: timeout", "Resolving URL for: x", "All processing complete!", "Extracción con éxito", "lote iniciado", "FAILED once"]
_STEPS = ["Analizando artículos (5/11)...", "Extrayendo texto de artículos", "Iniciando análisis LLM", "Análisis completo",
          "Fetching discovery (10%)...", "nothing known"]


def _listed_sql(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "][turn % 6 + 1]"


def _any_sql(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_SAID_SQL = f"""
said AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE substring(text, 1, length(text) // 2) || ' ' || {_listed_sql(_LOG)} || ' ' || text END AS m,
         CASE WHEN text = '' THEN '' WHEN turn % 7 = 0 THEN text ELSE text || {_listed_sql(_STEPS)} || text END AS s
  FROM conversations)"""
_CLASS_SQL = " ".join(f"WHEN {_any_sql('m', e)} OR {_any_sql('lower(m)', a)} THEN '{n}'" for n, e, a in S.MESSAGE_CLASSES)
_LABEL_SQL = " ".join(f"WHEN {_any_sql('s', words)} THEN '{label}'" for words, label in S.STEP_LABELS)
_COUNTER_SQL = r"'(?i)Anal(izando artículos|yzing articles)\s*(\(\d+/\d+\)\.\.\.)'"


@query("log_class", sql(_SAID_SQL, body=f"""
SELECT conv_id, turn, CASE {_CLASS_SQL} ELSE 'running' END AS message_class,
  CASE WHEN s = '' THEN '{S.DEFAULT_STEP}' WHEN regexp_matches(s, {_COUNTER_SQL})
       THEN 'Analyzing articles ' || regexp_extract(s, {_COUNTER_SQL}, 2) {_LABEL_SQL} ELSE s END AS step
FROM said"""))
def log_class(spark, sf):
    """Messages and steps inside whole chat texts."""
    text, at = F.col("text"), (F.col("turn") % 6 + 1).cast("int")
    listed = lambda words: F.element_at(F.array(*map(F.lit, words)), at)
    half = F.substring(text, F.lit(1), F.expr("char_length(text) div 2"))
    message = F.when(F.col("turn") % 2 == 0, text).otherwise(F.concat_ws(" ", half, listed(_LOG), text))
    step = F.when(text == "", "").when(F.col("turn") % 7 == 0, text).otherwise(F.concat(text, listed(_STEPS), text))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.message_class(message).alias("message_class"), X.step_label(step).alias("step"))


@query("fenced_blocks", r"""
WITH told AS (
  SELECT conv_id, turn, CASE turn % 4
    WHEN 0 THEN text || chr(10) || '```SQL' || chr(10) || ' SELECT "' || text || '" AS t' || chr(10) || '```' || text
    WHEN 1 THEN '  Select "' || text || '" ' WHEN 2 THEN text || '```json {"locations": ["' || text || '"]}' || chr(10) || '``` ' || text ELSE text END AS t
  FROM conversations), bare AS (SELECT *, trim(t, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS b FROM told)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?is)```sql\s*.*?\s*```') THEN trim(regexp_extract(t, '(?is)```sql\s*(.*?)\s*```', 1))
    WHEN starts_with(lower(b), 'select') THEN b END AS statement,
  nullif(regexp_extract(replace(replace(t, '```json', ''), '```', ''), '(?s)(\{.*\})', 1), '') AS object FROM bare""")
def fenced_blocks(spark, sf):
    """Blocks around and between whole chat texts."""
    text, kind = F.col("text"), F.col("turn") % 4
    told = (
        F.when(kind == 0, F.concat(text, F.lit('\n```SQL\n SELECT "'), text, F.lit('" AS t\n```'), text))
        .when(kind == 1, F.concat(F.lit('  Select "'), text, F.lit('" ')))
        .when(kind == 2, F.concat(text, F.lit('```json {"locations": ["'), text, F.lit('"]}\n``` '), text)).otherwise(text))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.fenced_sql(told).alias("statement"), X.first_object(told).alias("object"))


def cited_answers(spark, sf):
    """Every article is cited by every second order of it: whole id, eight digits, or its number."""
    kind = F.col("pos") % 4
    mark = F.when(kind == 0, F.col("article_id")).when(kind == 1, F.substring("article_id", 1, 8)).when(
        kind == 2, F.concat(F.lit("missing-"), F.col("pos").cast("string")))
    return article_keys(spark, sf).select(
        "pos", F.concat(F.lit("See [Article ID: "), F.coalesce(mark, F.regexp_extract("url", "([0-9]+)$", 1)),
                        F.lit("] and [Article ID:none]")).alias("text"))


_CITED_SQL = """
cited AS (SELECT DISTINCT unnest(['none', CASE pos % 4 WHEN 0 THEN article_id WHEN 1 THEN substring(article_id, 1, 8)
            WHEN 2 THEN 'missing-' || pos ELSE regexp_extract(url, '[0-9]+$') END]) AS cited FROM articles)"""


@query("citations", sql(*NEWS, _CITED_SQL, body="SELECT cited FROM cited"))
def citations(spark, sf):
    return cited_answers(spark, sf).select(F.explode(X.citations(F.col("text"))).alias("cited")).distinct()


@query("citation_lookup", sql(*NEWS, _CITED_SQL, """
hits AS (SELECT cited, min(pos) AS pos FROM cited JOIN articles ON starts_with(article_id, cited) OR contains(url, cited) GROUP BY cited)""",
                              body="""
SELECT c.cited, a.article_id, a.url FROM cited c LEFT JOIN hits h ON h.cited = c.cited LEFT JOIN articles a ON a.pos = h.pos"""))
def citation_lookup(spark, sf):
    return R.citation_lookup(cited_answers(spark, sf), article_keys(spark, sf))


_HITS_SQL = f"""
kws AS (SELECT unnest({_keywords_sql("'" + QUESTION + "'")}) AS kw),
hits AS (SELECT * FROM articles WHERE EXISTS (SELECT 1 FROM kws WHERE contains(lower(title), kw))
         ORDER BY date DESC NULLS LAST, article_id, execution_id LIMIT 8)"""


def search_hits(spark, sf):
    """Keys and titles are searched; the few hits, written once, get their text and places afterwards."""
    words = R.keywords_of(spark, QUESTION)
    rows = with_text(article_keys(spark, sf), spark, sf).drop("scraped_text", "content_snippet")
    hits = durable(R.keyword_search(rows, words).drop("title"))
    return with_text(with_places(hits, spark, sf, few=True), spark, sf)


@query("keyword_search", sql(*NEWS, _HITS_SQL, body="SELECT article_id, execution_id, title, date FROM hits"))
def keyword_search(spark, sf):
    rows = with_text(article_keys(spark, sf), spark, sf).select("article_id", "execution_id", "title", "date")
    return R.keyword_search(rows, R.keywords_of(spark, QUESTION))


@query("latest_articles", sql(*NEWS, body="""
SELECT article_id, execution_id, date FROM articles ORDER BY date DESC NULLS LAST, article_id, execution_id LIMIT 5"""))
def latest_articles(spark, sf):
    """A question of filler words only: the newest articles instead."""
    words = R.keywords_of(spark, "¿Qué noticias hay? What about this?")
    return R.keyword_search(article_keys(spark, sf), words).select("article_id", "execution_id", "date")


@query("evidence_block", sql(*NEWS, _HITS_SQL, body="""
SELECT 'Relevant article excerpts found:' || chr(10) || string_agg(
  '[Article ID: ' || article_id || ']' || chr(10) || 'Title: ' || title || chr(10) || 'Source: ' || coalesce(source, 'None') ||
  ' | Date: ' || date || ' | Locations: ' || coalesce(geodata, 'None') || ' | Snippet: ' ||
  replace(trim(content_snippet, @WS@), chr(10), ' ') || chr(10), chr(10) ORDER BY date DESC, article_id, execution_id) AS evidence FROM hits""".replace("@WS@", _WS)))
def evidence_block(spark, sf):
    return R.evidence_block(search_hits(spark, sf))


@query("question_hits", sql(*NEWS, f"""
questions AS (SELECT conv_id * 100 + turn AS question_id, {_keywords_sql('text')} AS kws FROM conversations WHERE role = 'user'),
titles AS (SELECT DISTINCT title FROM articles),
title_hits AS (SELECT question_id, title FROM questions, titles
  WHERE len(list_filter(kws, lambda k: contains(lower(title), k))) > 0)""", body="""
SELECT question_id, article_id, execution_id, rank::INT AS rank FROM (
  SELECT question_id, article_id, execution_id, row_number() OVER (PARTITION BY question_id
    ORDER BY date DESC NULLS LAST, article_id, execution_id) AS rank FROM title_hits JOIN articles USING (title)) WHERE rank <= 8"""))
def question_hits(spark, sf):
    """Keyword search for every user turn at once."""
    turns = table(spark, sf, "conversations").filter(F.col("role") == "user")
    questions = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
                             X.question_keywords(F.col("text")).alias("keywords"))
    rows = with_text(article_keys(spark, sf), spark, sf).select("article_id", "execution_id", "date", "title")
    return R.search_many(questions, rows).select("question_id", "article_id", "execution_id", "rank")


# --- chat ---------------------------------------------------------------------------------------

def chat_history_rows(spark, sf):
    """conversations -> encrypted history; every fifth turn is an older plain row, every sixth is blank."""
    turn = F.col("turn")
    text = F.when(turn == 5, " ").otherwise(F.col("text"))
    stored = F.when(turn % 5 == 4, text).otherwise(crypto.encrypt_text(text, chat_key(spark)))
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, turn)")
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + turn).alias("id"), F.col("conv_id").cast("string").alias("execution_id"), "role",
        stored.alias("encrypted_content"), at.alias("timestamp"))


@query("chat_history", """
SELECT CAST(conv_id AS VARCHAR) AS execution_id, role, CASE WHEN turn = 5 THEN ' ' ELSE text END AS content,
       strftime(TIMESTAMP '2024-01-01' + to_minutes(turn), '%Y-%m-%dT%H:%M:%S') AS at FROM conversations""")
def chat_history(spark, sf):
    rows = chat_history_rows(spark, sf).orderBy("execution_id", "timestamp", "id")
    return rows.select("execution_id", "role", crypto.decrypt_text(F.col("encrypted_content"), chat_key(spark)).alias("content"),
                       F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("chat_memory", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
kept AS (SELECT *, trim(text, @WS@) AS content FROM ranked WHERE rn <= 6 AND turn <> 5)
SELECT CAST(conv_id AS VARCHAR) AS execution_id, coalesce(string_agg(role || ': ' || content, chr(10) ORDER BY turn), '') AS memory,
       coalesce(string_agg(role || ': ' || content, chr(10) ORDER BY turn) FILTER (rn <= 4), '') AS prompt_part, count(*) AS n_turns
FROM kept GROUP BY conv_id""".replace("@WS@", _WS))
def chat_memory(spark, sf):
    return R.chat_memory(chat_history_rows(spark, sf), chat_key(spark))


def _answered(spark, sf):
    turns = table(spark, sf, "conversations")
    ask = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ask.join(reply, ["conv_id", "turn"]).select(
        F.col("conv_id").cast("string").alias("execution_id"), "question", "answer",
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, turn)").alias("timestamp"))


_PAIRS_SQL = """
pairs AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


@query("chat_append", sql(_PAIRS_SQL, body="""
SELECT CAST(conv_id AS VARCHAR) AS execution_id, 'user' AS role, turn, strlen(question) AS n_bytes FROM pairs
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'assistant', turn, strlen(answer) FROM pairs"""))
def chat_append(spark, sf):
    """Two encrypted rows per answered question. The cipher text differs from run to run, its size does
    not: 12 bytes of nonce and 16 of tag around the text."""
    rows = R.chat_rows(_answered(spark, sf), chat_key(spark))
    size = F.octet_length(F.unbase64("encrypted_content")) - 28
    return rows.select("execution_id", "role", F.minute("timestamp").cast("long").alias("turn"),
                       size.cast("long").alias("n_bytes"))


@query("chat_append_table", sql(_PAIRS_SQL, """
told AS (
  SELECT CAST(conv_id AS VARCHAR) AS execution_id, turn, 'user' AS role, question AS content FROM pairs
  UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, 'assistant', answer FROM pairs),
first_load AS (SELECT *, row_number() OVER (ORDER BY substring(md5(execution_id), 1, 3), execution_id, turn, role DESC) AS id FROM told WHERE turn < 2),
second_load AS (SELECT *, (SELECT count(*) FROM told WHERE turn < 2) + row_number() OVER (
  ORDER BY substring(md5(execution_id), 1, 3), execution_id, turn, role DESC) AS id FROM told WHERE turn >= 2)""", body="""
SELECT id, execution_id, role, content FROM first_load UNION ALL SELECT id, execution_id, role, content FROM second_load"""))
def chat_append_table(spark, sf):
    """Two loads into the stored chat history, read back by its layout."""
    root, key = new_folder(spark, "mart"), chat_key(spark)
    turns = _answered(spark, sf)
    late = F.minute("timestamp") >= 2
    for part in (~late, late):
        R.append_chat(spark, root, turns.filter(part), key)
    stored = read_table(spark, root, "chat_history")
    return stored.select("id", "execution_id", "role", crypto.decrypt_text(F.col("encrypted_content"), key).alias("content"))


@query("chat_roundtrip", sql(_PAIRS_SQL, body="""
SELECT CAST(conv_id AS VARCHAR) AS execution_id, 'user' AS role, question AS content, question <> '' AS hidden FROM pairs
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'assistant', answer, answer <> '' FROM pairs"""))
def chat_roundtrip(spark, sf):
    rows = R.chat_rows(_answered(spark, sf), chat_key(spark))
    content = crypto.decrypt_text(F.col("encrypted_content"), chat_key(spark))
    return rows.select("execution_id", "role", content.alias("content"), (F.col("encrypted_content") != content).alias("hidden"))


# --- summary and ad-hoc SQL ---------------------------------------------------------------------

@query("summary_text", sql(*RUNS_NEWS, """
src AS (SELECT source, count(*) AS n FROM articles GROUP BY source ORDER BY n DESC, source NULLS FIRST LIMIT 5),
plc AS (SELECT place, count(*) AS n FROM (SELECT unnest(places) AS place FROM articles) GROUP BY place ORDER BY n DESC, place LIMIT 15)""",
                           body="""
SELECT 1 AS section, '1' AS line_key, '  - Total scraped articles: ' || count(*) AS line FROM articles
UNION ALL SELECT 1, '2', '  - Detected date range: ' || min(date) || ' to ' || max(date) FROM articles
UNION ALL SELECT 1, '3', '  - Articles with geographic location: ' || count(*) FILTER (geodata <> '[]') FROM articles
UNION ALL SELECT 2, lpad(CAST(1000000000000000 - n AS VARCHAR), 16, '0') || ' ' || coalesce(source, ''),
                 '      * ' || coalesce(source, 'None') || ': ' || n || ' articles' FROM src
UNION ALL SELECT 3, lpad(CAST(1000000000000000 - n AS VARCHAR), 16, '0') || ' ' || place, '      * ' || place || ': ' || n || ' articles' FROM plc
UNION ALL SELECT 4, execution_id, '      * ''' || search_term || ''' (' || status || ') scraped: ' ||
   coalesce(strftime(scraped_at, '%Y-%m-%d %H:%M:%S'), 'None') FROM executions WHERE status IN ('SCRAPING', 'SCRAPED', 'ANALYZING')"""))
def summary_text(spark, sf):
    return R.summary_text(articles(spark, sf), executions(spark, sf))


AD_HOC = "SELECT e.search_term, a.source, count(*) AS n FROM articles a JOIN search_executions e ON a.execution_id = e.execution_id " \
         "GROUP BY e.search_term, a.source ORDER BY n DESC, e.search_term, a.source"


def _views(spark, sf):
    R.register_views(articles(spark, sf).select("article_id", "execution_id", "url", "date", "source", "geodata", "image_url"),
                     executions(spark, sf))


@query("safe_sql", sql(*RUNS_NEWS, body="""
SELECT e.search_term, a.source, count(*) AS n FROM articles a JOIN executions e USING (execution_id) GROUP BY ALL"""))
def safe_sql(spark, sf):
    _views(spark, sf)
    return R.safe_sql(spark, AD_HOC)


@query("sql_result_text", sql(*RUNS_NEWS, """
result AS (SELECT e.search_term, a.source, count(*) AS n FROM articles a JOIN executions e USING (execution_id) GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (ORDER BY n DESC, search_term, source NULLS FIRST) AS line_no FROM result)""", body="""
SELECT 0::BIGINT AS line_no, 'search_term, source, n' AS line
UNION ALL SELECT line_no, search_term || ', ' || coalesce(source, 'None') || ', ' || n FROM numbered WHERE line_no <= 50
UNION ALL SELECT 51, '... (truncado a 50 resultados de ' || (SELECT count(*) FROM result) || ')' WHERE (SELECT count(*) FROM result) > 50"""))
def sql_result_text(spark, sf):
    _views(spark, sf)
    return R.answer_sql(spark, AD_HOC)


