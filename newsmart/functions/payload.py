"""Cleaning of request payloads of any shape: every text in them loses tags and javascript: prefixes, names stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.functions.text import clean_payload

#: Levels of objects and lists inside each other that a payload may have.
DEPTH = 6
TOO_DEEP = "payload is nested too deep"


def clean_nested(c: Column, kind: T.DataType) -> Column:
    """A column of a declared type with every text in it cleaned: in structs, lists and the values of maps."""
    if isinstance(kind, T.StringType):
        return clean_payload(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: clean_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: clean_nested(x, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [clean_nested(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return clean_variant(c) if isinstance(kind, T.VariantType) else c


def clean_variant(c: Column, depth: int = DEPTH) -> Column:
    """A VARIANT tree folded from its leaves: texts are cleaned, lists and objects are built again from their cleaned items.
    A tree deeper than ``depth`` levels is an error rather than left as it is."""
    kind = F.schema_of_variant(c)
    is_list, is_object = F.startswith(kind, F.lit("ARRAY")), F.startswith(kind, F.lit("OBJECT"))
    leaf = F.when(kind == "STRING", clean_payload(c.cast("string")).cast("variant")).otherwise(c)
    if depth == 0:
        return F.when(is_list | is_object, F.raise_error(F.lit(TOO_DEEP)).cast("variant")).otherwise(leaf)
    items = F.transform(c.cast("array<variant>"), lambda x: clean_variant(x, depth - 1))
    fields = F.transform_values(c.cast("map<string,variant>"), lambda _, x: clean_variant(x, depth - 1))
    return F.when(is_list, F.to_variant_object(items)).when(is_object, F.to_variant_object(fields)).otherwise(leaf)


def clean_json(c: Column, depth: int = DEPTH) -> Column:
    """JSON text with every text in it cleaned; null if it is no JSON."""
    return F.to_json(clean_variant(F.try_parse_json(c), depth))
