"""JSON, array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.text import strip


def json_strings(c: Column) -> Column:
    """JSON array text -> array<string>; NULL for null, objects and broken text."""
    parsed = F.from_json(c, "array<string>")
    return F.when(F.trim(c).startswith("["), parsed)


def hydrate_places(geodata: Column, states: Column | None = None) -> Column:
    """Places of an article from its geodata text, else from an older states text, else empty."""
    empty = F.array().cast("array<string>")
    parts = [json_strings(geodata)] + ([json_strings(states)] if states is not None else [])
    return F.coalesce(*parts, empty)


def places_or_none(places: Column) -> Column:
    """The places, or the single 'no place' label when there are none."""
    return F.when(F.size(F.coalesce(places, F.array())) > 0, places).otherwise(F.array(F.lit(S.NO_PLACE)))


def named_places(places: Column) -> Column:
    """As places_or_none, with blank names dropped first."""
    return places_or_none(F.filter(places, lambda p: strip(p) != ""))


def run_country(filters: Column) -> Column:
    """Country of a run from its filters text; the default for missing, blank or broken text."""
    found = F.from_json(filters, "map<string,string>")["country"]
    return F.coalesce(F.when(found != "", found), F.lit(S.DEFAULT_COUNTRY))


def filter_chips(filters: Column) -> Column:
    """Non-empty key:value pairs joined by blanks."""
    pairs = F.map_entries(F.from_json(filters, "map<string,string>"))
    shown = F.filter(pairs, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.coalesce(
        F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " "), F.lit("")
    )


def trigger_label(selected: Column, kind: str) -> Column:
    """Text of a filter's button: all, the one that is picked, or how many are."""
    n = F.size(F.coalesce(selected, F.array().cast("array<string>")))
    return F.when(n == 0, f"All {kind}s").when(n == 1, F.get(selected, F.lit(0))).otherwise(F.concat(n, F.lit(f" {kind}s")))


def compact_json(**fields: Column) -> Column:
    """JSON object without NULL, '' and [] members; 0 and false stay."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def drop_blank(c: Column) -> Column:
    return F.when(c != "", c)


def drop_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)
