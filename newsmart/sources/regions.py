"""Region names (GeoJSON) and country settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.nested import run_country


def region_rows(documents: DataFrame) -> DataFrame:
    """(country, geojson text) -> (country, pos, state_name) in file order; unnamed features drop out."""
    doc = F.from_json("geojson", S.GEOJSON)
    rows = documents.select("country", F.posexplode(doc["features"]).alias("pos", "_f"))
    name = F.col("_f.properties.state_name")
    return rows.select("country", "pos", name.alias("state_name")).filter(F.coalesce(name, F.lit("")) != "")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """All ``<country>_states.geojson`` files of a folder; no file, no rows."""
    files = (
        spark.read.option("wholetext", "true").option("pathGlobFilter", "*_states.geojson").text(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_states\.geojson$", 1).alias("country"),
            F.col("value").alias("geojson"),
        )
    )
    return region_rows(files)


def config_rows(config: DataFrame) -> DataFrame:
    """JSON text of the country settings (column ``config``) -> one row per country key."""
    entries = config.select(F.explode(F.from_json("config", S.COUNTRY_CONFIG)).alias("key", "_c"))
    return entries.select("key", F.coalesce("_c.country_name", "key").alias("country_name"), "_c.hl", "_c.gl", "_c.ceid",
                          F.get("_c.center", F.lit(0)).alias("lat"), F.get("_c.center", F.lit(1)).alias("lon"), "_c.zoom",
                          F.coalesce("_c.llm_hints", F.lit("")).alias("llm_hints"))


def default_config_json() -> str:
    return json.dumps(S.COUNTRY_DEFAULTS)


def with_map(settings: DataFrame, regions: DataFrame) -> DataFrame:
    """Settings of countries that have region names."""
    have = regions.select(F.col("country").alias("key")).distinct()
    return settings.join(have, "key", "left_semi")


def resolve_country(runs: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings of each run's country; unknown countries take those of the default country."""
    lowered = F.lower(run_country(F.col("filters")))
    known = settings.select(F.col("key").alias("_key"))
    keyed = runs.withColumn("_wanted", lowered).join(known, F.col("_wanted") == F.col("_key"), "left")
    final = keyed.withColumn("key", F.coalesce("_key", F.lit(S.DEFAULT_COUNTRY))).drop("_key", "_wanted")
    return final.join(settings, "key")
