"""Keyword retrieval with evidence, citations, chat memory, corpus summary and guarded SELECTs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions import crypto
from newsmart.functions.text import citations, question_keywords, strip
from newsmart.operators import bits, sqlguard
from newsmart.operators.analytics import most_frequent
from newsmart.operators.grams import contained
from newsmart.operators.ranking import first_rows, hash_bucket, numbered_first_rows, table_position
from newsmart.sources import versions as V
from newsmart.sources.tables import fitted, layout
from newsmart.sources.versions import durable


def _newest() -> list[Column]:
    return [F.col("date").desc_nulls_last(), F.col("article_id").asc(), F.col("execution_id").asc()]


def keywords_of(spark: SparkSession, question: str) -> list[str]:
    """Keywords of one question (one row, evaluated by the same expression as whole tables of them)."""
    return spark.range(1).select(question_keywords(F.lit(question)).alias("k")).first()[0]


def keyword_search(articles: DataFrame, keywords: list[str], k: int = 8, latest: int = 5) -> DataFrame:
    """Newest articles whose title contains any keyword. Without keywords: just the newest ones."""
    if not keywords:
        return articles.orderBy(*_newest()).limit(latest)
    title = F.lower("title")
    hit = F.lit(False)
    for word in keywords:
        hit = hit | title.contains(word)
    return articles.filter(hit).orderBy(*_newest()).limit(k)


def search_many(questions: DataFrame, articles: DataFrame, k: int = 8) -> DataFrame:
    """keyword_search for a table of (question_id, keywords), without comparing questions to articles.

    A keyword is a run of at least four letters, so it can only sit inside one letter run of a title. Keywords meet the
    distinct title words that contain them through an index of their grams (``grams.py``); each keyword keeps its k newest
    articles, which contain the k newest of any set of keywords."""
    pairs = questions.select("question_id", F.explode(F.array_distinct("keywords")).alias("keyword"))
    wanted = pairs.select("keyword").distinct()
    runs = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-záéíóúñ]{4,})"), F.lit(1)))
    posts = articles.select("article_id", "execution_id", "date", F.explode(runs).alias("word"))
    newest_per_word = first_rows(posts, ["word"], _newest(), k)
    words = newest_per_word.select("word").distinct()
    inside = contained(wanted, words, "keyword", "word", size=4)
    per_keyword = first_rows(
        inside.join(newest_per_word, "word").drop("word").distinct(), ["keyword"], _newest(), k
    )
    hits = pairs.join(per_keyword, "keyword").drop("keyword").distinct()
    return numbered_first_rows(hits, ["question_id"], _newest(), "rank", k)


def evidence_lines(place_text: str = "geodata") -> Column:
    """Text block of one article."""
    text = strip(F.coalesce(F.when(F.col("content_snippet") != "", F.col("content_snippet")),
                             F.lit("No text available")))
    part = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return F.concat(
        F.lit("[Article ID: "), F.col("article_id"), F.lit("]\nTitle: "), part("title"),
        F.lit("\nSource: "), part("source"), F.lit(" | Date: "), part("date"),
        F.lit(" | Locations: "), part(place_text), F.lit(" | Snippet: "), F.replace(text, F.lit("\n"), F.lit(" ")),
        F.lit("\n"),
    )


def evidence_block(hits: DataFrame) -> DataFrame:
    """One text for a short hit list, newest first, undated last; a fixed sentence when nothing was found."""
    rows = hits.select("date", "article_id", "execution_id", evidence_lines().alias("block"))
    day = lambda row: F.coalesce(row["date"], F.lit(""))
    order = lambda a, b: (
        F.when(day(a) > day(b), -1).when(day(a) < day(b), 1)
        .when(a["article_id"] < b["article_id"], -1).when(a["article_id"] > b["article_id"], 1)
        .when(a["execution_id"] < b["execution_id"], -1).otherwise(1)
    )
    listed = rows.agg(F.collect_list(F.struct("date", "article_id", "execution_id", "block")).alias("l"))
    blocks = F.array_join(F.array_sort("l", order)["block"], "\n")
    return listed.select(
        F.when(F.size("l") > 0, F.concat(F.lit("Relevant article excerpts found:\n"), blocks))
        .otherwise("No relevant articles found for the query.").alias("evidence")
    )


#: Bits of the filter over cited ids, at most (16 MB).
CITED_BITS = 1 << 27


def citation_lookup(answers: DataFrame, articles: DataFrame, text: str = "text") -> DataFrame:
    """(cited, article_id, url) for every id cited in the answers: the first article (by pos) whose id
    starts with it or whose address contains it.

    Ids meet articles by equality: each article (once, at its first place) offers its id prefixes and address parts of just
    the lengths that are cited. A filter of bits over the cited ids, sized by their number, drops the parts that nobody cited
    (all but some in a thousand; more than half of them at fifty million ids) before anything is shuffled. What is left shrinks
    to its first place within each task, so a part that every address holds ("http") moves one row a task; only the part and
    the place move, and the articles at these places are looked up afterwards."""
    cited = durable(answers.select(F.explode(citations(F.col(text))).alias("cited")).distinct())
    facts = cited.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("cited"))).alias("l")).first()
    may = bits.may_hold(cited, "cited", facts["n"], CITED_BITS)
    lengths = F.array(*map(F.lit, facts["l"])).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("article_id")), lambda n: F.substring("article_id", F.lit(1), n)
    )
    parts = F.flatten(F.transform(
        F.filter(lengths, lambda n: n <= F.length("url")),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.length("url") - n + 1), lambda i: F.substring(F.col("url"), i, n)
        ),
    ))
    places = articles.groupBy("article_id", "url").agg(F.min("pos").alias("pos"))
    offers = places.select("pos", F.explode(F.array_distinct(F.concat(prefixes, parts))).alias("cited")).filter(may(F.col("cited")))
    lowest = F.when(F.max(F.col("pos").isNull()), None).otherwise(F.min("pos"))  # none comes before all others
    found = cited.join(offers.groupBy("cited").agg(lowest.alias("_pos")), "cited")
    there = places.join(found, F.col("pos").eqNullSafe(F.col("_pos"))).filter(
        F.startswith("article_id", "cited") | F.contains("url", "cited"))  # articles that share a place
    first = there.groupBy("cited").agg(F.min(F.struct("pos", "article_id", "url")).alias("_f"))
    return cited.join(first, "cited", "left").select("cited", "_f.article_id", "_f.url")


def chat_memory(turns: DataFrame, key: Column, keep: int = S.CHAT_TURNS, prompt: int = 4) -> DataFrame:
    """Per conversation the newest turns, oldest first, as one text, and the part used for the prompt.
    Blank turns drop out after the cut."""
    newest = numbered_first_rows(turns, ["execution_id"], [F.col("timestamp").desc(), F.col("id").desc()], "_rn", keep)
    plain = newest.withColumn("content", strip(crypto.decrypt_text(F.col("encrypted_content"), key)))
    line = F.struct((-F.col("_rn")).alias("o"), F.concat_ws(": ", "role", "content").alias("line"), "content")
    lines = F.filter(F.array_sort(F.collect_list(line)), lambda x: F.coalesce(x["content"], F.lit("")) != "")
    listed = plain.groupBy("execution_id").agg(lines.alias("_l"))
    last = F.filter("_l", lambda x: x["o"] >= -prompt)
    return listed.select(
        "execution_id", F.array_join(F.col("_l")["line"], "\n").alias("memory"),
        F.array_join(last["line"], "\n").alias("prompt_part"), F.size("_l").cast("long").alias("n_turns"),
    )


def chat_rows(turns: DataFrame, key: Column) -> DataFrame:
    """Two encrypted rows (user, assistant) per answered question."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    rows = turns.select("execution_id", "timestamp", F.inline(pair))
    return rows.select("execution_id", "role", crypto.encrypt_text(F.col("content"), key).alias("encrypted_content"),
                       "timestamp")


def append_chat(spark: SparkSession, root: str, turns: DataFrame, key: Column) -> int:
    """Adds the two encrypted rows of every answered question to the stored chat history, with the next ids; returns the
    version that holds them. Ids follow run, time and role; a rival's rows that come in between push them on."""
    rows = durable(chat_rows(turns, key))
    order = [F.col("execution_id"), F.col("timestamp"), F.col("role").desc(), F.col("encrypted_content")]
    numbered = table_position(rows, hash_bucket(F.coalesce("execution_id", F.lit(""))), order, "_n")

    def attempt(version: int, current: int | None) -> tuple[list[str], dict, list[str]]:
        base, top, old = f"{root}/chat_history", 0, []
        if current is not None:
            old = V.entry(spark, base, current)["data"]
            top = V.read_version(spark, base, current, layout("chat_history")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        folder = V.new_data(base)
        fitted("chat_history", numbered.withColumn("id", F.col("_n") + top).drop("_n")).write.parquet(f"{base}/{folder}")
        return [*old, folder], {}, [folder]

    return V.committed(spark, f"{root}/chat_history", attempt)


def corpus_summary(articles: DataFrame) -> DataFrame:
    """Totals and text date range in one pass. Rows without places text drop out of the located count."""
    return articles.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("geodata") != "[]").alias("with_geodata"),
        F.coalesce(F.min("date"), F.lit("Unknown")).alias("first_date"),
        F.coalesce(F.max("date"), F.lit("Unknown")).alias("last_date"),
    )


def ongoing_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin(S.ONGOING_STATUSES))


def summary_text(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """Lines of the corpus summary; read them by (section, line_key)."""
    row = lambda section, key, *parts: F.struct(
        F.lit(section).alias("section"), F.lit(key).alias("line_key"), F.concat(*parts).alias("line")
    )
    head = corpus_summary(articles).select(F.inline(F.array(
        row(1, "1", F.lit("  - Total scraped articles: "), "total"),
        row(1, "2", F.lit("  - Detected date range: "), "first_date", F.lit(" to "), "last_date"),
        row(1, "3", F.lit("  - Articles with geographic location: "), "with_geodata"),
    )))

    def counted(df: DataFrame, name: str, section: int) -> DataFrame:
        order = F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.lit(" "), F.coalesce(name, F.lit("")))
        line = F.concat(F.lit("      * "), F.coalesce(name, F.lit("None")), F.lit(": "), "n", F.lit(" articles"))
        return df.select(F.lit(section).alias("section"), order.alias("line_key"), line.alias("line"))

    sources = counted(most_frequent(articles, F.col("source"), "source", 5), "source", 2)
    places = counted(most_frequent(articles, F.explode("places"), "place", 15), "place", 3)
    active = ongoing_runs(runs).select(
        F.lit(4).alias("section"), F.col("execution_id").alias("line_key"),
        F.concat(F.lit("      * '"), "search_term", F.lit("' ("), "status", F.lit(") scraped: "),
                 F.coalesce(F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))).alias("line"),
    )
    return head.unionByName(sources).unionByName(places).unionByName(active)


def register_views(articles: DataFrame, runs: DataFrame) -> None:
    """Names that ad-hoc SELECTs may use."""
    for name in ("articles", "fact_news_metrics"):
        sqlguard.publish(name, articles)
    sqlguard.publish("dim_date", articles.select("date").distinct())
    sqlguard.publish("dim_source", articles.select("source").distinct())
    for name in ("search_executions", "scraper_logs"):
        sqlguard.publish(name, runs)


REFUSED = "Error: No valid SELECT query generated."


def safe_sql(spark: SparkSession, text: str | None, views: Iterable[str] | None = None) -> DataFrame:
    """Runs a SELECT, with or without WITH in front, over published views (``register_views``; or those named here).

    What it may hold is in ``sqlguard``; all else is refused. Several statements do not parse."""
    query = (text or "").strip().rstrip(";")
    if not re.match(r"(select|with)\b", query, re.I) or sqlguard.faults(spark, query, views):
        raise ValueError(REFUSED)
    return spark.sql(query)


def sql_result_text(result: DataFrame, most: int = S.SQL_ROWS) -> DataFrame:
    """Lines (line_no, line): header, up to ``most`` rows in the order of the query, and a note with the total when there
    are more. The statement runs once, here: its lines are written to the work folder, head and total are read from there."""
    named = result.toDF(*(f"c{i}" for i in range(len(result.columns))))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in named.columns]
    lines = durable(named.select(F.monotonically_increasing_id().alias("n"), F.concat_ws(", ", *cells).alias("line")))
    head = lines.orderBy("n").limit(most).select(F.row_number().over(Window.orderBy("n")).cast("long").alias("line_no"), "line")
    total = lines.agg(F.count(F.lit(1)).alias("n"))
    row = lambda no, text: F.struct(F.lit(no).cast("long").alias("line_no"), text.alias("line"))
    note = F.concat(F.lit(f"... (truncado a {most} resultados de "), F.col("n"), F.lit(")"))
    edges = total.select(F.inline(F.array(
        row(0, F.when(F.col("n") == 0, "No results found.").otherwise(", ".join(result.columns))),
        row(most + 1, F.when(F.col("n") > most, note)),
    ))).filter(F.col("line").isNotNull())
    return head.unionByName(edges)


def answer_sql(spark: SparkSession, text: str | None, views: Iterable[str] | None = None) -> DataFrame:
    """safe_sql and its text; a statement that is refused, or fails while it is analysed or run, becomes one error line."""
    try:
        return sql_result_text(safe_sql(spark, text, views))
    except ValueError as exc:
        message = str(exc)
    except PySparkException as exc:
        message = f"Database error during execution: {exc}"
    return spark.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(message).alias("line"))
