"""Tables with record ids, appends and deletes.

A heap is a folder of immutable Parquet files. A record's id is its file and row
number there, which Spark's file metadata gives without a stored column, so ids
hold as long as files are not rewritten; this class never does. Deletes add ids to
a tombstone table, and every read leaves those out by an anti-join.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from korrel.schema import Table

_IDS = "file string, row long"


class RecordID(NamedTuple):
    file: str
    row: int


class HeapFile:
    def __init__(self, spark: SparkSession, path: str):
        """Open a heap; a missing or foreign folder raises."""
        self.spark, self.path = spark, path.rstrip("/")
        self.fields = spark.read.parquet(f"{self.path}/data").schema

    @classmethod
    def create(cls, spark: SparkSession, path: str, fields: StructType) -> HeapFile:
        """A new empty heap; an existing one raises."""
        return cls.bulk_load(spark, path, spark.createDataFrame([], fields))

    @classmethod
    def bulk_load(cls, spark: SparkSession, path: str, df: DataFrame) -> HeapFile:
        """A new heap with the rows of ``df``; an existing one raises."""
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/data")
        return cls(spark, path)

    def _tombstones(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deleted")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], _IDS)
        return self.spark.read.schema(_IDS).parquet(f"{self.path}/deleted")

    def _all(self, files: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data"] if files is None else [f"{self.path}/data/{f}" for f in files]
        df = self.spark.read.schema(self.fields).parquet(*paths)
        return df.select(F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("id"), F.struct("*").alias("record"))

    def scan_with_ids(self, files: list[str] | None = None) -> DataFrame:
        """(id, record) of every live record, of some files only if given."""
        dead = self._tombstones()
        rows = self._all(files)
        return rows.join(dead, (F.col("id.file") == dead.file) & (F.col("id.row") == dead.row), "left_anti")

    def scan(self, name: str) -> Table:
        """Every live record."""
        return Table(name, self.scan_with_ids().select("record.*"))

    def insert(self, rows: DataFrame) -> DataFrame:
        """Append records; their ids (file, row), in the order in which they were written.

        The new files are written beside the heap and then moved into it, so that no
        scan sees a part of them while they are written and their names are known.
        """
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in self.fields]:
            raise TypeError(f"the fields are {self.fields.simpleString()}, not {rows.schema.simpleString()}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        new = f"{self.path}/incoming-{uuid.uuid4().hex}"
        rows.write.parquet(new)
        fs = hadoop(new).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files = sorted(name for name in (f.getPath().getName() for f in fs.listStatus(hadoop(new))) if name.startswith("part-"))
        for name in files:
            if not fs.rename(hadoop(f"{new}/{name}"), hadoop(f"{self.path}/data/{name}")):
                raise OSError(f"{new}/{name} could not be moved into the heap")
        fs.delete(hadoop(new), True)
        if not files:
            return self.spark.createDataFrame([], _IDS)
        return self._all(files).select("id.*")

    def insert_one(self, record: tuple) -> RecordID:
        """Append one record; its id."""
        return RecordID(*self.insert(self.spark.createDataFrame([tuple(record)], self.fields).coalesce(1)).first())

    def _row(self, record_id: RecordID) -> Row:
        found = self._all([record_id.file]).filter((F.col("id.file") == record_id.file) & (F.col("id.row") == record_id.row)).head(1)
        if not found:
            raise KeyError(f"no record {record_id}")
        return found[0].record

    def get(self, record_id: RecordID) -> Row | None:
        """The record, None if it is deleted; an id that never was raises."""
        record = self._row(record_id)
        dead = self._tombstones().filter((F.col("file") == record_id.file) & (F.col("row") == record_id.row))
        return None if dead.head(1) else record

    def delete(self, record_id: RecordID) -> None:
        """Delete a record; again is no error, an id that never was raises."""
        self._row(record_id)
        self.delete_all(self.spark.createDataFrame([tuple(record_id)], _IDS))

    def delete_all(self, ids: DataFrame) -> None:
        """Delete the records of all ids (file, row)."""
        ids.select("file", "row").distinct().write.mode("append").parquet(f"{self.path}/deleted")
