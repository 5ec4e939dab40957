"""Fields whose shape differs from row to row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_number(value: Column, default: float = 3.0) -> Column:
    """A text as a number; what is none, an object or null included, counts as the default."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def first_of_nested(references: Column) -> Column:
    """The first text of each inner list; empty lists go."""
    return F.filter(F.transform(references, lambda r: F.get(r, F.lit(0))), lambda x: x.isNotNull())


def scaled(weights: Column, by: Column | float) -> Column:
    """A map's values times a number."""
    return F.transform_values(weights, lambda _, v: v * by)


def query_text(row: Column) -> Column:
    """The query of a JSON row, which is a text or an object with `content`; null where there is neither."""
    held = F.get_json_object(row, "$.query")
    return F.when(F.startswith(F.ltrim(held), F.lit("{")), F.get_json_object(row, "$.query.content")).otherwise(held)


def field_or(row: Column, path: str, default: str) -> Column:
    """A field of a JSON row by its path, or the default."""
    return F.coalesce(F.get_json_object(row, path), F.lit(default))


def disjoint(a: Column, b: Column) -> Column:
    """Whether two lists share nothing; empty and null lists share nothing."""
    none = F.array().cast("array<string>")
    return F.size(F.array_intersect(F.coalesce(a, none), F.coalesce(b, none))) == 0
