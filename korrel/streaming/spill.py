"""Row streams on disk: self-describing tables, whole or split by a partition number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.schema import Table

PARTITION = "partition"


def write(table: Table, path: str) -> None:
    """Write a table; an existing one raises."""
    table.df.write.mode("errorifexists").parquet(path)


def scan(spark: SparkSession, path: str, name: str) -> Table:
    return Table(name, spark.read.parquet(path))


def write_partitioned(table: Table, path: str, number: Column, partitions: int) -> None:
    """Write each row to the partition that ``number`` gives; one out of range raises."""
    message = F.lit(f"the partition number is not in 0..{partitions - 1}")
    checked = F.when((number >= 0) & (number < partitions), number.cast("int")).otherwise(F.raise_error(message).cast("int"))
    table.df.withColumn(PARTITION, checked).write.mode("errorifexists").partitionBy(PARTITION).parquet(path)


def scan_partition(spark: SparkSession, path: str, name: str, number: int) -> Table:
    """One partition's rows; only its files are read."""
    df: DataFrame = spark.read.parquet(path)
    return Table(name, df.filter(F.col(PARTITION) == number).drop(PARTITION))
