"""Strict CSV: the header must be the declared fields, every cell must parse."""

from __future__ import annotations

import csv

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from korrel.schema import Table, column


def csv_scan(spark: SparkSession, path: str, name: str, fields: StructType, multi_line: bool | None = None) -> Table:
    """A table from CSV files with a header line.

    Raises on an empty file and on a header that differs in names, case, order or
    number; reading raises on short and long rows and on cells that do not parse,
    empty numeric cells included, whichever columns the query reads. Empty string
    cells are empty strings. ``multi_line`` allows line breaks in quoted cells but
    reads each file in one task. By default it is on only if a line has an odd number
    of quotes, which every cell with a line break has; without such a line large files
    are split.
    """
    first = spark.read.text(path, lineSep="\n").head(1)
    if not first:
        raise ValueError(f"{path} is empty: no header line")
    header = next(csv.reader([first[0].value.removeprefix("﻿").rstrip("\r")]), [])
    if header != fields.names:
        raise ValueError(f"the header {header} is not {fields.names}")
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    loose = StructType([*fields])
    df = spark.read.schema(loose).options(header=True, enforceSchema=False, mode="FAILFAST", quote='"', escape='"', multiLine=multi_line).csv(path)
    numbers = [f.name for f in fields if not isinstance(f.dataType, StringType)]
    if numbers:
        # Named in a filter, the numeric columns are parsed whatever is selected above.
        bad = F.lit(False)
        for n in numbers:
            bad = bad | column(n).isNull()
        df = df.filter(F.when(bad, F.raise_error(F.lit(f"{path}: a numeric cell is empty"))).otherwise(F.lit(True)))
    return Table(name, df.select(*(F.coalesce(column(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else column(f.name) for f in fields)))
