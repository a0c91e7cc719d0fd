"""JSON and vector column functions (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def json_field(col: Column | str, path: str) -> Column:
    """Text at a JSON path of a JSON-text column (``doc->>'key'``); null when absent."""
    return F.get_json_object(_c(col), path)


def json_parse(col: Column | str, schema: T.DataType | str) -> Column:
    """JSON text -> typed value; bad JSON gives null, not an error."""
    return F.from_json(_c(col), schema)


def json_serialize(df: DataFrame, name: str) -> Column:
    """Nested value -> JSON text with null fields kept; strings pass through unchanged, null stays null.

    The decision is made from the column type at plan time, since ``to_json`` does not accept a string.
    """
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col, {"ignoreNullFields": "false"})
    return col.cast("string")


def vector_sanitize(col: Column | str) -> Column:
    """NaN elements -> null elements (the served table cannot store NaN)."""
    return F.transform(_c(col), lambda x: F.when(F.isnan(x), F.lit(None).cast("float")).otherwise(x))


def vector_parse(df: DataFrame, name: str) -> Column:
    """A vector that arrives either as an array or as JSON text -> ``array<float>``."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return F.from_json(F.col(name), "array<float>")
    return F.col(name).cast("array<float>")


def vector_to_json(col: Column | str) -> Column:
    return F.to_json(_c(col))

