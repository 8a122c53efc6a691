"""Expressions used by several plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: str | Column) -> Column:
    """A double as a decimal of two places: sums of these don't depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(12,2)")


def cents(column: str | Column) -> Column:
    """A double as whole cents."""
    return (money(column) * 100).cast("long")


def json_number(column: str, path: str) -> Column:
    """A number of a JSON text; null if the text isn't JSON or has none there."""
    return F.get_json_object(column, path).try_cast("double")


def norm(column: str) -> Column:
    """The length of a vector."""
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: str, b: str) -> Column:
    """The cosine of two vectors; null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))
