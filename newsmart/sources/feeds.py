"""RSS search feeds: landed files or item texts -> article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.dates import feed_date
from newsmart.operators.pages import decode_entities, visible_text
from newsmart.operators.ranking import numbered_first_rows

def first_image(description: Column) -> Column:
    found = F.regexp_extract(description, r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']""", 1)
    return F.when(found != "", decode_entities(found))


def item_columns(item: str = "item") -> list[Column]:
    """Article fields of a parsed feed item."""
    f = lambda name: F.col(f"{item}.{name}")
    text = F.coalesce(f("description"), F.lit(""))
    return [
        f("guid").alias("guid"),
        F.coalesce(f("title"), F.lit("")).alias("title"),
        f("link").alias("url"),
        feed_date(f("pubDate")).alias("date"),
        F.when(f("source").isNull(), S.DEFAULT_SOURCE).otherwise(f("source._VALUE")).alias("source"),
        F.coalesce(f("source._url"), F.lit("")).alias("source_url"),
        visible_text(text).alias("summary"),
        first_image(text).alias("feed_image_url"),
    ]


def parse_items(items: DataFrame, xml: str = "xml") -> DataFrame:
    """Item texts (one <item> element per row) -> article fields beside the other columns."""
    parsed = items.withColumn("item", F.from_xml(F.col(xml), S.FEED_ITEM))
    return parsed.select(*[c for c in items.columns if c != xml], *item_columns())


def candidates(items: DataFrame, feed: str, pos: str, wanted: int) -> DataFrame:
    """First items of each feed: three times the wanted number of articles (at most the fixed maximum)."""
    most = S.CANDIDATE_FACTOR * min(wanted, S.MAX_ARTICLES)
    return numbered_first_rows(items, [feed], [F.col(pos)], "_item_no", most).drop("_item_no")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files: feed = file name, pos = order inside the file."""
    raw = spark.read.schema(S.FEED_ITEM).option("rowTag", "item").xml(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("feed"), F.monotonically_increasing_id().alias("pos"),
        F.struct("guid", "title", "link", "pubDate", "source", "description").alias("item"),
    )
    return rows.select("feed", "pos", *item_columns())


def unresolved(url: Column) -> Column:
    """Addresses that still point at the search service."""
    return url.contains("news.google.com")
