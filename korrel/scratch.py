"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Only a single-JVM local session, as in tests, may lack the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _local:
            _local[application] = "file://" + tempfile.mkdtemp(prefix="korrel-")
        found = _local[application]
    return found.rstrip("/")


#: Folders made for single-JVM sessions, by application.
_local: dict[str, str] = {}


class Scratch:
    """Written intermediate tables: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/korrel-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        """A new place below the shared folder."""
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if folder.removeprefix("file:").lstrip("/").startswith(self.root.removeprefix("file:").lstrip("/") + "/"):
                self._delete(folder)

    def _delete(self, path: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def bucketed(self, df: DataFrame, name: str, buckets: int, keys: Sequence[str], order: Sequence[str]) -> str:
        """``df`` written as a table in buckets of ``keys``, sorted by ``order``; the table's name.

        Its files are in the shared folder, not in the warehouse.
        """
        table = f"korrel_{name}_{uuid.uuid4().hex}"
        path = self.path(name)
        df.write.bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(table)
        self.tables[table] = path
        return table

    def drop_table(self, table: str) -> None:
        """Delete a bucketed table and its files."""
        self.spark.sql(f"drop table if exists {table}")
        if table in self.tables:
            self._delete(self.tables.pop(table))

    def release(self) -> None:
        """Let Spark remove shuffle files of plans that are out of use."""
        gc.collect()
        self.spark._jvm.System.gc()
