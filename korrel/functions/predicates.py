"""Predicates as boolean columns, typed like the field they test."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.schema import Table, column


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    return {int: "int", float: "float", str: "string"}.get(type(value), type(value).__name__)


def equals(table: Table, field: str, value: Any, nan_equal: bool = True) -> Column:
    """field = value; false everywhere if the value's type is not the field's.

    NaN equals NaN as in Spark, unless ``nan_equal`` is off.
    """
    kind = table.kind(field)
    if _kind(value) != kind:
        return F.lit(False)
    test = column(field) == F.lit(value)
    return test & ~F.isnan(column(field)) if kind == "float" and not nan_equal else test


def less(table: Table, field: str, value: Any) -> Column:
    """field < value; strings compare byte-wise; another type of value raises."""
    kind = table.kind(field)
    if _kind(value) != kind:
        raise TypeError(f"{field} is {kind}, the value is {_kind(value)}")
    return column(field) < F.lit(value)


def custom(function: Callable[..., bool], *fields: str) -> Column:
    """Any function of some fields, as a last resort: it runs in Python, row batches at a time."""
    @F.pandas_udf("boolean")
    def apply(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(function(*x)) for x in rows.itertuples(index=False, name=None)], dtype=bool)

    return apply(F.struct(*(column(f) for f in fields)))
