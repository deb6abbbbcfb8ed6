"""Sorting, merging, limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame

from korrel.schema import Table, column, same_fields


def _keys(field: str, descending: bool, ties: Sequence[str]) -> list[Column]:
    return [column(field).desc() if descending else column(field).asc(), *(column(f) for f in ties)]


def sort(table: Table, field: str, descending: bool = False, ties: Sequence[str] = ()) -> Table:
    """Rows in the order of one field; ``ties`` make equal ones' order definite. Spills by itself."""
    table.kind(field)
    return Table(table.name, table.df.orderBy(*_keys(field, descending, ties)))


def merge(tables: Sequence[Table], field: str, descending: bool = False, ties: Sequence[str] = ()) -> Table:
    """All rows of tables with the same fields, in order of one field."""
    if not tables:
        raise ValueError("nothing to merge")
    same_fields(tables)
    every = reduce(DataFrame.unionAll, (t.df for t in tables))
    return sort(Table(tables[0].name, every), field, descending, ties)


def limit(table: Table, n: int) -> Table:
    """The first n rows, all if there are fewer; a negative n raises."""
    if n < 0:
        raise ValueError("the limit is negative")
    return Table(table.name, table.df.limit(n))


def top_k(table: Table, field: str, k: int, descending: bool = True, ties: Sequence[str] = ()) -> Table:
    """The first k rows in an order; each task keeps k rows, no full sort."""
    return limit(sort(table, field, descending, ties), k)
