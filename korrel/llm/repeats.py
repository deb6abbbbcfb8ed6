"""Common ground of the two exact repeat removers: one copy of each text, kept in
buckets by document, and the sampled positions whose strings occur twice.

Documents are ordered by id, null ids last, in the order of a hash of the text. Their
place in that order is (``did``, ``v``): ``did`` is the id without its last bit, for a
null id a number from the text's hash above all ids, so that texts without an id are
spread over the buckets too; ``v`` numbers the texts of one ``did``. A text that equals an earlier
document's as a whole is set aside first: every window of it starts earlier, so
the copy is known without comparing, and large groups of copies cost one row
each. Rows with equal id and text are one document and get the same result; rows
with equal id and different texts are documents of their own, in the order of a
hash of the text. An empty table gives no rows; texts of any length are read whole,
in segments. Columns other than id and text are carried in one struct, whatever
their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm.common import Scratch, pieces, texts
from korrel.llm.windows import anchors, mix

_LAST = (1 << 63) - 1
_HALF = 1 << 62
#: Sampled positions that a task groups at once before they are shuffled.
HELD = 1 << 19
#: ``at`` packs a text's number, a place and whether the task has the string many times.
_ANCHORS = pa.schema([("k", pa.int64()), ("did", pa.int64()), ("at", pa.int64())])


def byte_units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def word_units(found: list[bytes]) -> np.ndarray:
    """A hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


class Corpus:
    """``rows``: (row, id, t1, t2) of every row, ``row`` being its columns but the text.
    ``texts``: (did, v, id, t1, t2, text) of every distinct text at its first document."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.spark, self.scratch = docs.sparkSession, scratch
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
        keys = [own_id.alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
        others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
        self.rows = scratch.keep(docs.select(F.struct(*others).alias("row"), *keys), "rows")
        firsts = self.rows.groupBy("t1", "t2").agg(F.min("id").alias("id")).withColumn("did", _did())
        firsts = firsts.withColumn("v", F.row_number().over(Window.partitionBy("did").orderBy("id", "t1", "t2")) - 1)
        firsts = firsts.select(F.col("did").alias("fd"), F.col("id").alias("f"), F.col("t1").alias("f1"), F.col("t2").alias("f2"), "v")
        own = docs.select(*keys, text.alias("text")).withColumn("did", _did())
        own = own.join(firsts, F.col("did") == F.col("fd")).filter("id = f and t1 = f1 and t2 = f2").select("did", "v", "id", "t1", "t2", "text")
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = own.repartition(self.buckets, "did")
        if not self.rows.groupBy("id", "t1", "t2").count().filter("count > 1").isEmpty():
            own = own.dropDuplicates(["did", "v"])
        self.name = scratch.bucketed(own, "texts", self.buckets, ["did"], ["did", "v"])

    @property
    def texts(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.scratch.drop_table(self.name)


def _did() -> Column:
    """Where a document (id, t1) stands in the order, ``_LAST`` being no id."""
    hashed = F.col("t1").bitwiseAND(F.lit(_HALF - 1)) + F.lit(_HALF)
    return F.when(F.col("id") == _LAST, hashed).otherwise(F.shiftright("id", 1))


@contextlib.contextmanager
def corpus(docs: DataFrame) -> Iterator[Corpus]:
    own = Corpus(docs, Scratch(docs.sparkSession))
    own.scratch.release()
    try:
        yield own
    finally:
        own.close()
        own.scratch.release()


def sampled(units: Callable[[str], np.ndarray], span: int, gram: int) -> Callable:
    """A ranking of all sampled positions by their ``gram``-unit strings."""

    def ranks(text: str, _: None) -> tuple[np.ndarray, np.ndarray]:
        pos, hashes, _, _ = anchors(units(text), span, gram)
        return hashes, pos << 1

    return ranks


def repeated(docs: DataFrame, ranks: Callable) -> DataFrame:
    """(did, found): places whose rank occurs more than once, as array<long> of v << 33 | place.

    ``docs`` are (did, v, text[, found]); ``ranks(text, places)`` gives hashes and
    places of a text, from the places found before if there are any. A place is a
    position doubled, plus 0 or 1. A task groups what it reads first: a string that
    it has many times is handed to the string's group once, and its other rows pass
    to any task.
    """

    def group(rows: list[tuple]) -> pa.RecordBatch:
        hashes, did, v, place = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes, did, v, place = hashes[order], did[order], v[order], place[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        many = ~new | np.concatenate((~new[1:], [False]))
        spread = mix(mix(did.astype(np.uint64)) + place.astype(np.uint64))
        k = np.where(new, hashes, spread).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, did, v.astype(np.int64) << 34 | place << 1 | many)], schema=_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for part in pieces(batch, limit=4 << 20):
                vs = part.column("v").to_pylist()
                places = wanted(part) if "found" in part.schema.names else [None] * len(vs)
                for did, v, text, before in zip(part.column("did").to_pylist(), vs, texts(part), places, strict=True):
                    if before is None or v in before:
                        hashes, place = ranks(text, before and before[v])
                        if len(place):
                            rows.append((hashes, np.full(len(place), did, dtype=np.int64), np.full(len(place), v), place))
                            held += len(place)
                    if held >= HELD:
                        yield group(rows)
                        rows, held = [], 0
        if rows:
            yield group(rows)

    found = docs.mapInArrow(run, "k long, did long, at long")
    same = Window.partitionBy("k")
    found = found.withColumn("n", F.count("*").over(same)).withColumn("many", F.max(F.col("at").bitwiseAND(1)).over(same)).filter("n > 1 or many = 1")
    return found.groupBy("did").agg(F.collect_list(F.shiftright("at", 1)).alias("found"))


def positions(part: pa.RecordBatch, column: str, *fields: str) -> list[tuple[np.ndarray, ...]]:
    """A list-of-struct column, per row, as arrays of its fields."""
    lists = part.column(column)
    offsets = lists.offsets.to_numpy()
    values = [lists.values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    valid = lists.is_valid().to_pylist()
    return [tuple(x[a:b] if ok else x[:0] for x in values) for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid, strict=True)]


def wanted(part: pa.RecordBatch) -> list[dict[int, np.ndarray]]:
    """Column ``found``, per row, as places by text number."""
    lists = part.column("found")
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        v, place = values[a:b] >> 33, values[a:b] & ((1 << 33) - 1)
        out.append({int(x): place[v == x] for x in np.unique(v)})
    return out


#: No position.
NOWHERE = np.empty(0, dtype=np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals; touching ones are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


def candidate_windows(units: np.ndarray, places: np.ndarray, span: int, gram: int):
    """Of the anchors at given places: (position, hash, windows' flat numbers, windows per anchor)."""
    pos, hashes, first, last = anchors(units, span, gram)
    keep = np.isin(pos, places >> 1)
    return windows_of(pos[keep], hashes[keep], first[keep], last[keep])


def windows_of(pos: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Anchors with the numbers of their windows, ``first``..``last``, in one array."""
    sizes = last - first + 1
    flat = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return pos, hashes, flat, sizes


class Seen:
    """Names met before by this task, so that its repeats need not be shuffled.

    It only saves work: it forgets when it is full or when documents come out of order.
    """

    LIMIT = 2_000_000

    def __init__(self):
        self.runs: list[np.ndarray] = []  # sorted, each at least twice as long as the next
        self.last = -1

    def repeats(self, names: np.ndarray, first_did: int, last_did: int) -> np.ndarray:
        """Whether each name, in document order, came before."""
        if first_did <= self.last or sum(map(len, self.runs)) > self.LIMIT:
            self.runs = []
        self.last = last_did
        order = np.argsort(names, kind="stable")
        inorder = names[order]
        new = np.ones(len(names), dtype=bool)
        new[1:] = inorder[1:] != inorder[:-1]
        distinct, places = inorder[new], order[new]
        fresh = np.ones(len(distinct), dtype=bool)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, distinct), len(run) - 1)
            fresh &= run[at] != distinct
        again = np.ones(len(names), dtype=bool)
        again[places[fresh]] = False
        if fresh.any():
            self.runs.append(distinct[fresh])
        while len(self.runs) > 1 and 2 * len(self.runs[-1]) > len(self.runs[-2]):
            self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]), kind="stable")]
        return again


def outcome(own: Corpus, removed: DataFrame, finish: Callable, span: int, schema: pa.Schema, columns: str) -> DataFrame:
    """Every row with what its text's intervals (did, v, start, end) leave.

    ``finish(text, starts, ends)`` gives the values of ``schema`` after its first two
    fields (t1, t2), which start with n and n_removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for v, text, (vs, starts, ends) in zip(part.column("v").to_pylist(), texts(part), positions(part, "cuts", "v", "start", "end"), strict=True):
                    mine = vs == v
                    rows.append(finish(text, *merged(starts[mine].astype(np.int64), ends[mine].astype(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column("t1"), part.column("t2"), part.column("id"), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[3:], strict=True))], schema=schema)

    cuts = removed.groupBy("did").agg(F.collect_list(F.struct("v", "start", "end")).alias("cuts"))
    found = own.texts.join(cuts, "did", "left").select("t1", "t2", "id", "v", "text", "cuts").mapInArrow(run, columns)
    found = found.withColumnRenamed("id", "first")
    return own.rows.join(found, ["t1", "t2"], "left")
