"""Rows given by the caller."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from korrel.schema import Table


def memory_scan(spark: SparkSession, name: str, fields: StructType, rows: Iterable[tuple], position: str | None = None) -> Table:
    """A table of the rows. ``position`` names a column that keeps their order."""
    rows = list(rows)
    df = spark.createDataFrame(rows, fields) if position is None else spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], StructType([*fields]).add(position, "long", nullable=False))
    return Table(name, df)
