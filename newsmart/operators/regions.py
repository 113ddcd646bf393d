"""Matching of place names to regions, choropleth classes and location tagging.

Neither compares every name with every region: names and regions that contain each other meet through an index of their
characters (``grams.py``), and texts meet region names through the words these begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.text import fold, without_marks
from newsmart.operators.grams import contained
from newsmart.sources.versions import durable, few_rows

#: Names that a model function may be given as a Python list.
MODEL_NAMES = 10_000


def padded_words(c: Column) -> Column:
    """Folded words with single blanks between and around them, so that ' word ' finds whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def region_names(regions: DataFrame) -> list[str]:
    """The names themselves, in file order, for a model function; refused when it is no country's list."""
    return few_rows(regions.select("pos", "state_name"), MODEL_NAMES).sort_by("pos")["state_name"].to_pylist()


def _may_pair(name: Column, region: Column) -> Column:
    """Rules against false hits of names that contain each other."""
    both_baja = name.contains("baja california") & region.contains("baja california")
    sur_differs = name.contains("sur") != region.contains("sur")
    capital = (name == "mexico") & (region == "ciudad de mexico")
    return ~(both_baja & sur_differs) & ~capital


def match_regions(names: DataFrame, regions: DataFrame, name: str = "place") -> DataFrame:
    """Adds region: equal normalised name first, else the first region (by ``pos``) that contains the name or is contained in
    it, else the name itself; null for null and empty names. Give it distinct names; neither list has a bound.

    A name of accents alone is contained in every region, as the empty text is."""
    norms = names.select(fold(F.col(name)).alias("_norm")).filter(F.coalesce(name, F.lit("")) != "").distinct()
    listed = regions.select("pos", "state_name", fold(F.col("state_name")).alias("_region"))
    firsts = listed.groupBy("_region").agg(F.min(F.struct("pos", F.col("state_name").alias("name"))).alias("_first"))
    within = contained(norms, firsts, "_norm", "_region")
    around = contained(firsts, norms, "_region", "_norm").select("_norm", "_region")
    pairs = within.unionByName(around).filter(_may_pair(F.col("_norm"), F.col("_region")))
    near = pairs.join(firsts, "_region").groupBy("_norm").agg(F.min("_first").alias("_near"))
    exact = firsts.select(F.col("_region").alias("_norm"), F.col("_first.name").alias("_exact"))
    blank = firsts.agg(F.min(F.when(F.col("_region") == "", F.col("_first"))).alias("f")).scalar()
    first = firsts.agg(F.min("_first").alias("f")).scalar()
    anything = F.least(F.col("_near"), blank, F.when(F.col("_norm") == "", first))
    known = norms.join(exact, "_norm", "left").join(near, "_norm", "left")
    known = known.select("_norm", F.coalesce("_exact", anything["name"]).alias("_hit"))
    region = F.when(F.coalesce(name, F.lit("")) != "", F.coalesce("_hit", name))
    return names.withColumn("_norm", fold(F.col(name))).join(known, "_norm", "left").withColumn("region", region).drop("_norm", "_hit")


def colour_class(n: Column, most: Column) -> Column:
    ratio = F.when(most > 1, n / most).otherwise(F.lit(1.0))
    out = F.when(F.coalesce(n, F.lit(0)) <= 0, S.COLOUR_NONE)
    for bound, colour in S.COLOUR_CLASSES:
        out = out.when(ratio >= bound, colour)
    return out.otherwise(S.COLOUR_LOWEST)


def choropleth(articles: DataFrame, regions: DataFrame, count_unlocated: bool = False) -> DataFrame:
    """Articles per matched region, the highest count and the colour class. Names are counted first, so
    matching and the last sum see distinct names only."""
    places = F.filter(F.coalesce("places", F.array()), lambda p: p != "")
    if count_unlocated:
        places = F.when(F.size(places) > 0, places).otherwise(F.array(F.lit(S.NO_PLACE)))
    named = (
        articles.select(F.explode(places).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("_n"))
    )
    per_region = durable(match_regions(named, regions).groupBy("region").agg(F.sum("_n").alias("n")))
    most = per_region.agg(F.greatest(F.max("n"), F.lit(1)).alias("m")).scalar()
    return per_region.withColumn("max_n", most).withColumn("colour", colour_class(F.col("n"), F.col("max_n")))


def plain_words(c: Column) -> Column:
    """Words of letters, digits and underscores without accents, in their own case."""
    text = F.trim(F.regexp_replace(without_marks(c), r"[^\p{L}\p{N}_]+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def name_trie(regions: DataFrame, aliases: dict[str, str] | None = None, codes: dict[str, str] | None = None) -> DataFrame:
    """(first, rest, n, code, target): names of the region list and other names for them by their first word and the words
    that follow. ``aliases`` count in any case, ``codes`` (such as postal abbreviations, many of which are also common words)
    only as written. Other names of regions that are not in the list are left out."""
    listed = regions.select(F.col("state_name").alias("target")).distinct()
    named = listed.select(F.col("target").alias("name"), F.lit(False).alias("exact"), "target")
    others = [(k, exact, v) for d, exact in ((aliases, False), (codes, True)) for k, v in (d or {}).items()]
    if others:
        more = listed.sparkSession.createDataFrame(others, "name STRING, exact BOOLEAN, target STRING")
        named = named.unionByName(more.join(listed, "target", "left_semi").select(*named.columns))
    words = named.withColumn("_w", plain_words(F.col("name"))).filter(F.size("_w") > 0)
    lower = F.transform("_w", lambda w: F.lower(w))
    return words.select(
        F.get(lower, F.lit(0)).alias("first"), F.array_join(F.slice(lower, F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), " ").alias("rest"),
        F.size("_w").alias("n"), F.when(F.col("exact"), F.array_join("_w", " ")).alias("code"), "target",
    )


def tag_locations(
    docs: DataFrame, regions: DataFrame, key: str, title: str, text: str, aliases: dict[str, str] | None = None,
    codes: dict[str, str] | None = None,
) -> DataFrame:
    """(key, locations) of every document: regions named in the title, or, when there is none, in the text (all of it).

    Names count as whole words, accents and case aside. Every word of a text is looked up once among the first words of all
    names; only where it is one are the following words compared, so the list's length does not matter. Documents are told
    apart by ``key``; carry the result to whatever refers to them."""
    trie = name_trie(regions, aliases, codes)
    most = trie.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).scalar()
    parts = docs.select(F.col(key).alias("_key"), F.posexplode(F.array(plain_words(F.col(title)), plain_words(F.col(text)))).alias("_part", "_w"))
    spots = parts.select("_key", "_part", "_w", F.posexplode("_w").alias("_i", "_word"))
    ahead = F.array_join(F.slice("_w", F.col("_i") + 2, most - 1), " ")
    spots = spots.select("_key", "_part", "_word", F.lower("_word").alias("first"), ahead.alias("_ahead"))
    follows = (F.col("rest") == "") | F.startswith(F.concat(F.lower("_ahead"), F.lit(" ")), F.concat("rest", F.lit(" ")))
    as_written = F.col("code").isNull() | F.startswith(F.concat_ws(" ", "_word", "_ahead", F.lit("")), F.concat("code", F.lit(" ")))
    hits = spots.join(trie, "first").filter(follows & as_written).select("_key", "_part", "target").distinct()
    found = hits.groupBy("_key").agg(*(F.collect_set(F.when(F.col("_part") == p, F.col("target"))).alias(c) for p, c in ((0, "_title"), (1, "_text"))))
    places = F.when(F.size("_title") > 0, F.col("_title")).otherwise(F.col("_text"))
    both = docs.select(F.col(key).alias("_key")).join(found.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left")
    return both.select(F.col("_key").alias(key), F.array_sort(F.coalesce(places, F.array().cast("array<string>"))).alias("locations"))
