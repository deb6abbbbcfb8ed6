"""Self-describing tables: their fields are in the file."""

from __future__ import annotations

from pyspark.sql import SparkSession

from korrel.schema import Table


def parquet_scan(spark: SparkSession, path: str, name: str) -> Table:
    """A table from Parquet files; a missing path raises."""
    return Table(name, spark.read.parquet(path))
