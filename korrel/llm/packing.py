"""Best-fit packing of token sequences with large items matched first.

Lengths are whole numbers up to the capacity, so a packing is decided on their
histogram alone: at most ``capacity`` counts come to the driver, whatever the
corpus holds. Items above a third of the capacity go at most two to a bin, so
they are matched greedily, the longest with the longest that still fits. Smaller
items go, longest first, each into the least gap that takes it. Equal steps are
done at once: a row of the plan is a bin's contents and how many bins have them.
Every item then finds its place by its rank among items of its length, counted
per partition and added up with a window over partitions.

A null text counts as empty: one sequence of the end id alone. Repeated rows are
items of their own. Null ids stay null. Extra columns are not read. Documents longer than the capacity
are cut so that only their first piece may be short; a full piece is a bin.
Ids are those of the ``tokenizers`` file, its added tokens included: texts that hold
one go through that library, others through a faster one with the same vocabulary.
An empty table gives no rows; among items of one length any order is as good.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from korrel.llm.bpe import codec, read_ranks
from korrel.llm.common import Scratch, pieces

END = 2
CAPACITY = 1024
#: The library's splitter overflows its stack on longer runs of white space; those texts take this package's encoder.
_LONG_SPACE = regex.compile(r"\s{20000}")

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("k", pa.int64())])
_PLACES = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


@functools.lru_cache(maxsize=2)
def _library(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def _added(path: str) -> tuple[Tokenizer, re.Pattern]:
    """The file's own tokenizer, and a pattern of the tokens that it takes out of texts first."""
    own = Tokenizer.from_file(path)
    tokens = sorted(t.content for t in own.get_added_tokens_decoder().values())
    return own, re.compile("|".join(map(re.escape, tokens)) or r"(?!)")


def token_ids(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit numbers, by the ``tokenizers`` file at ``path``."""
    own, added = _added(path)
    if added.search(text):
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    if len(text) >= 20000 and _LONG_SPACE.search(text):
        return codec(path, pattern).encode(text)
    return np.asarray(_library(path, pattern).encode_to_numpy(text), dtype="<u4")


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = min(length, (length - 1) % capacity + 1)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def cut(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, numbered among those of their length in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for some in pieces(batch):
                rows = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = np.append(token_ids(text or "", path, pattern), np.array([END], dtype="<u4")).astype("<u4")
                    for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                        rows.append((doc_id, number, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, k long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins) that hold all items of a histogram."""
    left = defaultdict(int, {n: count for n, count in histogram.items() if count})
    #: By gap: the bins' contents and their number.
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((m for m in large if m <= capacity - length and left[m] > (m == length)), None)
            count = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
            items = (length,) if mate is None else (length, mate)
            for n in items:
                left[n] -= count
            open_bins[capacity - sum(items)].append((items, count))
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            gap = min((g for g, bins in open_bins.items() if g >= length and bins), default=capacity)
            items, count = open_bins[gap].pop() if open_bins[gap] else ((), left[length])
            fits = gap // length
            full = min(count, left[length] // fits)
            if full:
                open_bins[gap - fits * length].append((items + (length,) * fits, full))
                left[length] -= full * fits
            if full < count:
                rest = left[length]  # fewer than one bin takes
                if rest:
                    open_bins[gap - rest * length].append((items + (length,) * rest, 1))
                    left[length] = 0
                if items and count - full - bool(rest):
                    open_bins[gap].append((items, count - full - bool(rest)))
    return [x for bins in open_bins.values() for x in bins if x[0]]


class Places:
    """Where the item of a given length and rank goes, by a plan."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for items, count in bins:
            offset = 0
            for length in dict.fromkeys(items):
                each = items.count(length)
                rows.append((length, taken[length], first, each, offset))
                taken[length] += each * count
                offset += each * length
            first += count
        rows.sort()
        self.length, self.start, self.first, self.each, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        self.key = self.length << 44 | self.start
        self.bins = first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each item."""
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        past = rank - self.start[at]
        return self.first[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    scratch = Scratch(docs.sparkSession)
    items = scratch.keep(cut(docs, path, pattern, capacity), "pieces")
    counts = items.filter(F.col("length") < capacity).groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = scratch.keep(counts, "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, k, before = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "part", "k", "before"))
            bin_, offset = -1 - (part << 36 | k), np.zeros(len(length), dtype=np.int64)
            shared = np.flatnonzero(length < capacity)
            bin_[shared], offset[shared] = places.find(length[shared], (before + k)[shared])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_), pa.array(offset)], schema=_PLACES)

    # One row for each partition and length: it grows with the partitions, so it is merged, never broadcast.
    ranked = items.join(before.hint("merge"), ["part", "length"], "left").select("doc_id", "piece", "start", "length", "ids_crc32", "part", "k", F.coalesce("before", F.lit(0)).cast("long").alias("before"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
