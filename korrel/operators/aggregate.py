"""Averages and distinct rows, by hash aggregation, and by runs of adjacent rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions.values import as_double
from korrel.schema import Table, column, quoted
from korrel.scratch import Scratch


def average(table: Table, of: str, by: str, exact: bool = False) -> Table:
    """(by, average): the mean of one field per value of another.

    ``exact`` sums two-decimal amounts as decimals, so that the result does not
    depend on the order of rows.
    """
    table.kind(by)
    value = as_double(table, of)
    mean = F.sum(value.cast("decimal(18,2)")).cast("double") / F.count(value) if exact else F.avg(value)
    df = table.df.groupBy(column(by)).agg(mean.alias("average"))
    return Table(f"average({table.name}.{of})", df)


def distinct(table: Table) -> Table:
    """Each row once."""
    return Table(table.name, table.df.distinct())


def _runs(df: DataFrame, same: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with columns ``run`` and ``first``: runs of adjacent rows with equal ``same`` fields.

    Rows are range-partitioned by ``order`` and written once with the number of their
    partition, since another run of the same plan would cut the ranges elsewhere. Of
    each partition only its ends and the number of its runs meet the others' in one task.
    """
    value = F.struct(*(column(f) for f in same))
    inside = Window.partitionBy("part").orderBy(*(column(f) for f in order))
    rows = df.repartitionByRange(*(column(f) for f in order)).withColumn("part", F.spark_partition_id()).withColumn("value", value)
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("before", F.lag("value").over(inside))
    rows = rows.withColumn("inner", (F.col("place") > 1) & ~F.col("value").eqNullSafe(F.col("before"))).drop("before")
    rows = Scratch(df.sparkSession).keep(rows.withColumn("later", F.sum(F.col("inner").cast("long")).over(inside)), "runs")
    ends = rows.groupBy("part").agg(F.max_by("value", "place").alias("last"), F.min_by("value", "place").alias("head"), F.max("later").alias("later"))
    across = Window.orderBy("part")
    ends = ends.withColumn("new", ~F.col("head").eqNullSafe(F.lag("last").over(across)) | F.lag("last").over(across).isNull())
    ends = ends.withColumn("upto", F.sum(F.col("later") + F.col("new").cast("long")).over(across) - F.col("later"))
    rows = rows.join(F.broadcast(ends.select("part", "new", "upto")), "part")  # a row for each partition
    return rows.withColumn("first", F.when(F.col("place") == 1, F.col("new")).otherwise(F.col("inner"))).withColumn("run", F.col("upto") + F.col("later"))


def average_runs(table: Table, of: str, by: str, order: Sequence[str]) -> Table:
    """(by, average) per run of adjacent equal ``by`` values, rows being in the order of ``order``."""
    table.kind(by)
    rows = _runs(table.df.withColumn("korrel_of", as_double(table, of)), [by], order)
    df = rows.groupBy("run").agg(F.min(column(by)).alias(by), F.avg("korrel_of").alias("average"))
    return Table(f"average({table.name}.{of})", df.orderBy("run").select(column(by), "average"))


def distinct_runs(table: Table, order: Sequence[str], fields: Sequence[str] | None = None) -> Table:
    """Rows that differ from the one before, in ``fields`` or all, rows being in the order of ``order``."""
    rows = _runs(table.df, fields or table.fields, order)
    kept: list[Column] = [F.col(quoted(f)) for f in table.fields]
    return Table(table.name, rows.filter("first").orderBy(*(column(f) for f in order)).select(*kept))
