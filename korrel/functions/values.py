"""Scalar functions on values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.schema import Table, column


def as_double(table: Table, field: str, lenient: bool = False) -> Column:
    """A field as a double. A string that is no number raises, or is NULL if lenient."""
    kind = table.kind(field)
    if kind == "float":
        return column(field)
    return column(field).try_cast("double") if lenient else column(field).cast("double")


def parse(text: Column, kind: str) -> Column:
    """Text as a value of kind ``int``, ``float`` or ``string``; bad text raises."""
    if kind == "string":
        return F.coalesce(text, F.lit(""))
    return text.cast({"int": "int", "float": "double"}[kind])
