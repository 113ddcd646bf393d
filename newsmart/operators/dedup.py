"""First-seen de-duplication, gates and quotas of a search run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.text import strip
from newsmart.operators.ranking import first_rows, numbered_first_rows


def link(real_url: str = "real_url", url: str = "url") -> Column:
    """Resolved address, else the feed address, else empty text."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(filled(real_url), filled(url), F.lit(""))


def dedup_title(items: DataFrame, scope: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First item per title inside a feed; items without a title are dropped."""
    return first_rows(items.filter(F.coalesce(F.col("title"), F.lit("")) != ""), [*scope, "title"], order)


def skip_seen(items: DataFrame, stored: DataFrame, keys: Sequence[str] = ("execution_id", "title")) -> DataFrame:
    """Items whose (run, title) is not stored yet."""
    seen = stored.select(*keys).distinct()
    return items.join(seen, list(keys), "left_anti")


def quality_gate(articles: DataFrame, text: str = "scraped_text", least: int = S.MIN_ARTICLE_CHARS) -> DataFrame:
    return articles.filter(F.length(strip(F.col(text))) > least)


def dedup_url(articles: DataFrame, scope: Sequence[str], url: Column, order: Sequence[Column]) -> DataFrame:
    """First article per address inside the scope."""
    return first_rows(articles.withColumn("_url", url), [*scope, "_url"], order).drop("_url")


def dedup_url_quota(
    articles: DataFrame, scope: Sequence[str], url: Column, order: Sequence[Column], quota: Column
) -> DataFrame:
    """Unique addresses first, then the first ``quota`` rows of each run, numbered in ``rank``."""
    unique = dedup_url(articles, scope, url, order)
    ranked = numbered_first_rows(unique, scope, order, "rank", S.MAX_ARTICLES)
    return ranked.filter(F.col("rank") <= quota)


def long_enough(text: Column, least: int = S.MIN_ARTICLE_CHARS) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) > least


def search_counters(articles: DataFrame, scope: Sequence[str], url: Column, valid: Column, quota: Column | None = None) -> DataFrame:
    """Counters of a search run: buffer (all articles), valid (text ``long_enough``), unique (different addresses among these) and
    returned (at most the quota). Addresses are counted one group each before they are counted per run, so a large run is
    spread over its addresses."""
    each = articles.groupBy(*scope, url.alias("_url")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_good"))
    sums = each.groupBy(*scope).agg(
        F.sum("_n").alias("buffer"), F.sum("_good").alias("valid"), F.count_if(F.col("_good") > 0).alias("unique"))
    most = F.lit(S.DEFAULT_ARTICLES) if quota is None else quota
    return sums.withColumn("returned", F.least(F.col("unique"), most.cast("long")))


def selection_rank(cache: DataFrame, chosen: DataFrame, query: str) -> DataFrame:
    """Cache rows; those of ``query`` get ui_selected = rank of the chosen address, else 0. Rows of other
    queries keep their selection."""
    picks = chosen.select("url", F.col("rank").cast("int").alias("_rank"))
    return (
        cache.join(picks, "url", "left")
        .withColumn("ui_selected", F.when(F.col("query") == query, F.coalesce("_rank", F.lit(0))).otherwise(F.col("ui_selected")))
        .drop("_rank")
    )


def cache_replace(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Last row per address; its selection is cleared."""
    return first_rows(rows, ["url"], order).withColumn("ui_selected", F.lit(0))
