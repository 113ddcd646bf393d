"""Filters, KPIs, top lists, timeline and facets over articles with a ``places`` array column."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.dates import any_timestamp, day_bucket, iso_timestamp, span_label
from newsmart.functions.nested import named_places, places_or_none


@dataclass(frozen=True)
class Selection:
    """What a reader picked: sources, places and a date text ('a', 'a to b' or empty)."""

    sources: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    dates: str = ""

    def toggle(self, kind: str | None, value: str | None) -> Selection:
        """Picking the only picked value clears it, any other value replaces the pick; nothing resets all."""
        if not kind or not value:
            return Selection()
        field = {"state": "places", "source": "sources"}.get(kind.lower())
        if field is None:
            return self
        return replace(self, **{field: () if getattr(self, field) == (value,) else (value,)})

    def label(self) -> str:
        parts = []
        if self.places:
            parts.append("Estado: " + ", ".join(self.places))
        if self.sources:
            parts.append("Fuente: " + ", ".join(self.sources))
        return " | ".join(parts)


def _literals(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def selected(articles: DataFrame, pick: Selection, single_day: bool = True) -> DataFrame:
    """Rows of the selection. Missing or unreadable dates pass, and so do all rows when a bound is unreadable; ``single_day`` lets one date mean that day."""
    out = articles
    if pick.sources:
        out = out.filter(F.col("source").isin(list(pick.sources)))
    if pick.places:
        out = out.filter(F.arrays_overlap(places_or_none(F.col("places")), _literals(pick.places)))
    first, sep, last = pick.dates.strip().partition(" to ")
    if sep or (first and single_day):
        at = iso_timestamp(F.col("date"))
        start = F.try_to_timestamp(F.lit(first.strip()))
        end = F.try_to_timestamp(F.lit((last or first).strip())) + F.expr("interval 1 day")
        out = out.filter(F.coalesce((at >= start) & (at < end), F.lit(True)))
    return out


def counted_places(pick: Selection = Selection()) -> Column:
    """Places an article counts for: all of them, or only the selected ones."""
    places = places_or_none(F.col("places"))
    if not pick.places:
        return places
    wanted = _literals(pick.places)
    return F.filter(places, lambda p: F.array_contains(wanted, p))


def value_counts(articles: DataFrame, pick: Selection = Selection(), blank_places: bool = True) -> DataFrame:
    """(kind, value, n) for places, sources and the article total, in one scan and one shuffle of
    already counted values."""
    places = counted_places(pick) if blank_places else named_places(F.col("places"))
    source = F.when(F.coalesce("source", F.lit("")) != "", F.col("source"))
    tag = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    items = F.concat(
        F.transform(places, lambda p: tag("place", p)),
        F.array(tag("source", source)),
        F.array(tag("total", F.lit(""))),
    )
    return (
        articles.select(F.inline(items)).filter(F.col("value").isNotNull())
        .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def kpis(articles: DataFrame, pick: Selection = Selection()) -> DataFrame:
    """Total, number of places, most frequent place and source (ties by name)."""
    return kpis_of(value_counts(articles, pick))


def kpis_of(counts: DataFrame) -> DataFrame:
    """KPIs out of (kind, value, n) counts."""
    is_ = lambda kind: F.col("kind") == kind
    top = lambda kind: F.coalesce(
        F.min_by(F.when(is_(kind), F.col("value")), F.when(is_(kind), F.struct(-F.col("n"), F.col("value")))),
        F.lit(S.NO_TOP),
    )
    return counts.agg(
        F.coalesce(F.sum(F.when(is_("total"), F.col("n"))), F.lit(0)).alias("total"),
        F.count(F.when(is_("place"), 1)).alias("coverage"),
        top("place").alias("epicenter"),
        top("source").alias("top_source"),
    )


def facets(articles: DataFrame) -> DataFrame:
    return value_counts(articles).filter(F.col("kind") != "total")


def _top(counts: DataFrame, name: str, k: int) -> DataFrame:
    """k most frequent names, ties by name, with bar intensity relative to the longest bar."""
    head = counts.orderBy(F.col("n").desc(), F.col(name)).limit(k)
    longest = F.max("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return head.withColumn("intensity", F.lit(0.25) + F.col("n") / F.greatest(longest, F.lit(1)) * F.lit(0.75))


def top_sources(articles: DataFrame, k: int = 10) -> DataFrame:
    named = articles.filter(F.coalesce("source", F.lit("")) != "")
    return _top(named.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", k)


def top_places(articles: DataFrame, k: int = 10, places: Column | None = None) -> DataFrame:
    chosen = named_places(F.col("places")) if places is None else places
    each = articles.select(F.explode(chosen).alias("place"))
    return _top(each.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "place", k)


def most_frequent(df: DataFrame, name: Column, out: str, k: int) -> DataFrame:
    """Plain top-k of a column or of an exploded array, ties by name."""
    return (
        df.select(name.alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(out)).limit(k)
    )


def timeline(articles: DataFrame) -> DataFrame:
    """Articles per day, ascending; unreadable dates stand under their first ten characters."""
    dated = articles.filter(F.coalesce("date", F.lit("")) != "")
    return dated.groupBy(day_bucket(F.col("date")).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day")


def date_span(articles: DataFrame) -> DataFrame:
    at = any_timestamp(F.col("date"))
    ends = articles.agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return ends.select(span_label(F.col("first"), F.col("last")).alias("label"))


def latest_rows(articles: DataFrame, k: int = 2) -> DataFrame:
    """The last collected articles, newest first."""
    return articles.orderBy(F.col("pos").desc()).limit(k)


def page(df: DataFrame, order: list[Column], number: int, size: int, first: int = 1) -> DataFrame:
    """One page of a sorted table with its row range; the page number is held inside the existing pages.

    The page is found by row bounds taken from the total, so out-of-range numbers need no second try."""
    total = df.count()
    pages = max(1, -(-total // size))
    index = min(max(number - first, 0), pages - 1)
    start = index * size
    return df.orderBy(*order).offset(start).limit(size).select(
        "*",
        F.lit(start + 1).cast("long").alias("page_start"),
        F.lit(min(start + size, total)).cast("long").alias("page_end"),
        F.lit(total).cast("long").alias("page_total"),
    )


def page_after(df: DataFrame, key: str, last_seen, size: int) -> DataFrame:
    """Next page by key: no rows are skipped over, whatever the depth."""
    rows = df if last_seen is None else df.filter(F.col(key) > F.lit(last_seen))
    return rows.orderBy(key).limit(size)
