"""What the operators of this subpackage share: inputs, shared scratch, links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.scratch import Scratch, shared_dir
from korrel.ship import ensure_importable

__all__ = ["Scratch", "by_row", "components", "documents", "look_up", "pieces", "prepare", "shared_dir", "texts"]


#: Bytes that go to a Python worker at once; rows are whole texts, so a number of rows is no bound.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Before operators that run Python: workers have the package, batches are small.

    A session's own smaller setting is kept.
    """
    ensure_importable(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for operators that run Python on the executors."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, at least a row."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    yield batch.slice(start, n - start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def by_row(schema: pa.Schema, row: Callable[..., tuple]) -> Callable:
    """A ``mapInArrow`` function from a function of one text, keeping the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [row(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(schema.field(0).type), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))],
                    schema=schema,
                )

    return run


#: Rows of a key up to which it is never hot, and the number of hot keys that a broadcast may hold at most.
HOT, MOST_HOT = 64, 1000


def look_up(rows: DataFrame, key: str, table: DataFrame, of: str, value: str, n: int) -> DataFrame:
    """``rows`` (n of them) with column ``value`` of ``table``, whose rows have different ``of``; null where it has none.

    Keys of more than ``max(HOT, n / 1000)`` rows, of which there are at most 1000 or
    ``n / HOT``, are looked up by a broadcast, so that no task gets all rows of a key.
    """
    most = max(HOT, n // MOST_HOT)
    hot = rows.groupBy(F.col(key).alias("korrel_hot")).agg(F.count("*").alias("korrel_n")).filter(F.col("korrel_n") > most).select("korrel_hot")
    entries = table.select(F.col(of).alias("korrel_of"), F.col(value).alias(value))
    hot_entries = hot.join(entries, F.col("korrel_hot") == F.col("korrel_of"), "left").select("korrel_hot", value)
    marked = rows.join(F.broadcast(hot_entries), F.col(key) == F.col("korrel_hot"), "left")
    cold = marked.filter("korrel_hot is null").drop("korrel_hot", value).join(entries, F.col(key) == F.col("korrel_of"), "left").drop("korrel_of")
    return cold.unionByName(marked.filter("korrel_hot is not null").drop("korrel_hot"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node reachable, for each node of ``edges(a, b)`` that is not its own root.

    Alternating large-star and small-star steps until nothing changes: the first
    points a node's greater neighbours, the second its lesser ones, at the least of
    them. A node that very many point at is looked up by a broadcast. Each round is
    written out.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    while True:
        # Large star: an edge (a, b) with a > b points a at the least neighbour of b.
        least = scratch.keep(now.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = look_up(now, "b", least, "a", "m", mark[0]).select("a", F.coalesce("m", "b").alias("b")).distinct()
        # Small star: the lesser neighbours of a point at the least of them.
        large = scratch.keep(large, "large")
        least_of = large.groupBy("a").agg(F.min("b").alias("m"))
        small = look_up(large, "a", least_of, "a", "m", mark[0]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        after = scratch.keep(small, "edges")
        for table in (now, least, large):
            scratch.drop(table)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    n, check = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, check
