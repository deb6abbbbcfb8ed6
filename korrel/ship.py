"""Makes the package importable for Python workers that do not have it."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_done: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Once an application: if a worker can't import the package, send it to all.

    ``--py-files`` or an installed package make this a look-up only.
    """
    application = spark.sparkContext.applicationId
    if application in _done:
        return

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = importlib.util.find_spec("korrel") is not None
            yield pa.RecordBatch.from_arrays([pa.array([found] * batch.num_rows, pa.bool_())], names=["found"])

    if not spark.range(1, numPartitions=1).mapInArrow(probe, "found boolean").first().found:
        root = Path(__file__).resolve().parent
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="korrel-")), "korrel.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)  # the driver serves it to executors
    _done.add(application)
