"""Cell semantics of the reference's column buffers as column expressions.

A double is missing as null or NaN; a long is missing as the least long.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEAST_LONG = -(1 << 63)
NUMERIC_TYPES = ("integer", "float", "double")


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def as_long(x: Column) -> Column:
    """Number cut to a long; missing is the least long."""
    return F.coalesce(null_if_nan(x.cast("double")).try_cast("long"), F.lit(LEAST_LONG).cast("long"))


def nullable_long(x: Column) -> Column:
    """Number cut to a long; missing is null."""
    return null_if_nan(x.cast("double")).try_cast("long")


def long_as_double(x: Column) -> Column:
    """A long cell as a double: the least long, and null, are NaN."""
    return F.when(x.isNull() | (x == F.lit(LEAST_LONG).cast("long")), F.lit("NaN").cast("double")).otherwise(x.cast("double"))


def number_or_error(x: Column) -> Column:
    """Text of a number as a double, missing as null; any other text fails the query."""
    value = x.try_cast("double")
    return F.when(x.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("Invalid value: "), x)).cast("double")).otherwise(value)


def buffer_type(data_type: str) -> str:
    """Spark type that a column of a Dataset-JSON data type is held in."""
    return "double" if data_type.lower() in NUMERIC_TYPES else "string"
