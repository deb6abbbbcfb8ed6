"""Projection, selection, materialisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Row

from korrel.schema import Table, column


def project(table: Table, fields: Sequence[str]) -> Table:
    """Named fields in the given order, repeats allowed; an unknown one raises."""
    for f in fields:
        table.kind(f)
    return Table(f"projection({table.name}, [{','.join(fields)}])", table.df.select(*(column(f) for f in fields)))


def select(table: Table, predicate: Column) -> Table:
    """Rows for which the predicate is true."""
    return Table(table.name, table.df.filter(predicate))


def materialise(table: Table) -> list[Row]:
    """All rows on the driver; an empty table gives an empty list."""
    return table.df.collect()
