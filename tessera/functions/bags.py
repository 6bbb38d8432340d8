"""Settings and metadata bags: JSON of no fixed schema, as VARIANT columns.

A bag is parsed once; typed fields are read by path, and a text that is no
JSON is kept, to be counted or looked at, instead of failing a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(text: Column) -> Column:
    """The text as a VARIANT; null when it is no JSON."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str = "string") -> Column:
    """The field at a path (``$.a.b[0]``) as a type; null when it is missing
    or does not fit."""
    return F.try_variant_get(value, path, kind)


def corrupt(text: Column) -> Column:
    """The text when it is no JSON."""
    return F.when(text.isNotNull() & F.try_parse_json(text).isNull(), text)


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.schema_of_variant(value)
    return F.when(value.isNull(), None).when(F.startswith(name, F.lit("OBJECT")), "object").when(
        F.startswith(name, F.lit("ARRAY")), "array").when(name == "STRING", "string").when(
        name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")


def with_bag(df: DataFrame, text_col: str, bag_col: str = "bag", corrupt_col: str = "corrupt") -> DataFrame:
    """``df`` with the parsed bag and the text of bags that are no JSON."""
    text = F.col(text_col)
    return df.withColumn(bag_col, bag(text)).withColumn(
        corrupt_col, F.when(F.col(bag_col).isNull() & text.isNotNull(), text))
