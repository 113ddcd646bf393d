"""Rules of a search request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmart.functions.text import strip


def rejections() -> Column:
    """Names of the fields that make a request invalid: blank query, no positive count, no country."""
    bad = lambda rule, name: F.when(rule, F.lit(name))
    return F.array_compact(F.array(
        bad(strip(F.coalesce("query", F.lit(""))) == "", "query"),
        bad(F.coalesce(F.col("nqueries").try_cast("int"), F.lit(0)) <= 0, "nqueries"),
        bad(F.col("country").isNull(), "country"),
    ))
