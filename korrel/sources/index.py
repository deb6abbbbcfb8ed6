"""Secondary indexes on a whole-number field of a heap.

An index is a table (key, file, row), range-partitioned and sorted by key, so a
lookup prunes its files and row groups by their key statistics; then only the heap
files that the found entries name are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.schema import KINDS, Table
from korrel.sources.heap import HeapFile

_ENTRIES = "key long, file string, row long"
#: Heap files named by a lookup above which the whole heap is listed instead.
FILES = 1000
#: Entries up to which a lookup is broadcast to the heap's files.
ENTRIES = 1_000_000


class Index:
    def __init__(self, spark: SparkSession, path: str):
        """Open an index; a missing path raises."""
        self.spark, self.path = spark, path
        spark.read.parquet(path)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Index:
        spark.createDataFrame([], _ENTRIES).write.mode("errorifexists").parquet(path)
        return cls(spark, path)

    @classmethod
    def bulk_load(cls, spark: SparkSession, path: str, entries: DataFrame, loading_factor: float = 1.0) -> Index:
        """A new index of at least one entry (key, file, row).

        ``loading_factor`` in (0, 1]: how full files are; less makes more of them.
        """
        if not 0 < loading_factor <= 1:
            raise ValueError("the loading factor must be in (0, 1]")
        if entries.isEmpty():
            raise ValueError("an index needs at least one entry")
        rows = entries.select(F.col("key").cast("long"), "file", "row")
        parts = max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) / loading_factor))
        rows.repartitionByRange(parts, "key").sortWithinPartitions("key").write.mode("errorifexists").parquet(path)
        return cls(spark, path)

    @classmethod
    def build(cls, path: str, heap: HeapFile, field: str, loading_factor: float = 1.0) -> Index:
        """An index of a heap's field."""
        if KINDS.get(type(heap.fields[field].dataType)) != "int":
            raise TypeError(f"{field} is not a whole number")
        entries = heap.scan_with_ids().select(F.col("record").getField(field).alias("key"), "id.file", "id.row")
        return cls.bulk_load(heap.spark, path, entries, loading_factor)

    def add(self, entries: DataFrame) -> None:
        """Add entries; equal keys are kept."""
        entries.select(F.col("key").cast("long"), "file", "row").write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(_ENTRIES).parquet(self.path)

    def find_equal(self, key: int) -> DataFrame:
        return self.entries().filter(F.col("key") == key)

    def find_greater_equal(self, key: int) -> DataFrame:
        """Entries from a key up, in key order."""
        return self.entries().filter(F.col("key") >= key).orderBy("key")

    def _fetch(self, found: DataFrame, heap: HeapFile) -> DataFrame:
        files = found.groupBy("file").count().limit(FILES + 1).collect()
        if not files:
            return heap.scan_with_ids().limit(0).select(F.lit(0).cast("long").alias("key"), "record")
        few = len(files) <= FILES
        rows = heap.scan_with_ids([r.file for r in files] if few else None)
        if few and sum(r["count"] for r in files) <= ENTRIES:
            found = F.broadcast(found)  # else the heap would be shuffled to meet a few entries
        return rows.join(found, (F.col("id.file") == found.file) & (F.col("id.row") == found.row)).select("key", "record")

    def scan_equal(self, heap: HeapFile, name: str, key: int) -> Table:
        """Live heap records whose indexed field is the key."""
        return Table(name, self._fetch(self.find_equal(key), heap).select("record.*"))

    def scan_greater_equal(self, heap: HeapFile, name: str, key: int) -> Table:
        """Live heap records from the key up, in key order."""
        found = self._fetch(self.entries().filter(F.col("key") >= key), heap)
        return Table(name, found.orderBy("key").select("record.*"))


