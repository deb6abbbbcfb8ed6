"""Typed tables: a name, declared fields and a DataFrame.

Three field types: whole numbers, doubles and strings. Columns never hold NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT32, FLOAT64, STRING = T.IntegerType(), T.DoubleType(), T.StringType()
#: Int64 is accepted as a wider Int32.
KINDS = {T.IntegerType: "int", T.LongType: "int", T.DoubleType: "float", T.StringType: "string"}


def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    """A schema of (name, type) pairs without NULLs."""
    for name, kind in fields:
        if type(kind) not in KINDS:
            raise TypeError(f"{name}: unsupported type {kind.simpleString()}")
    return T.StructType([T.StructField(n, k, nullable=False) for n, k in fields])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A column by its exact name, which may hold dots."""
    return F.col(quoted(name))


@dataclass(frozen=True)
class Table:
    name: str
    df: DataFrame

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    def kind(self, field: str) -> str:
        """``int``, ``float`` or ``string``; an unknown field raises."""
        if field not in self.fields:
            raise KeyError(f"{self.name} has no field {field!r}")
        found = self.df.schema[field].dataType
        if type(found) not in KINDS:
            raise TypeError(f"{field}: unsupported type {found.simpleString()}")
        return KINDS[type(found)]

    def renamed(self, name: str) -> Table:
        return Table(name, self.df)


def qualified(table: str, field: str) -> str:
    return f"{table}.{field}"


def joined_fields(r: Table, s: Table) -> list[str]:
    """``table.field`` names, first table first; a name met before gets a number so that the first stays addressable."""
    out: list[str] = []
    for table in (r, s):
        for field in table.fields:
            name, n = qualified(table.name, field), 1
            while name in out:
                n += 1
                name = f"{qualified(table.name, field)} ({n})"
            out.append(name)
    return out


def same_fields(tables: Sequence[Table]) -> None:
    first = tables[0].df.schema
    for t in tables[1:]:
        if [(f.name, f.dataType) for f in t.df.schema] != [(f.name, f.dataType) for f in first]:
            raise TypeError(f"{t.name} and {tables[0].name} have different fields")
