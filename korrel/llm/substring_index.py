"""Repeated word windows by a log-structured index of fingerprints.

The index is a few immutable runs: tables of window fingerprints, bucketed and
sorted by fingerprint, each with one row per window that documents so far have.
A new batch of documents is merge-joined with the runs, which needs no shuffle of
theirs. A match is verified by ``check``, a 64-bit hash of the window's bytes that has
nothing in common with ``h``, which comes from hashes of single words: windows whose
words only share their hashes stay apart, in the batch and in the index. What the
batch has first becomes a run of level 0, and two runs of one level are merged,
bucket by bucket and without a shuffle, into one of the next: of n batches there are
at most log2(n) + 1 runs, and a row is written again as often.

A window is ``span`` words; a word is covered if a window over it occurred in an
earlier batch, or earlier in its batch by document order and place. Batches are
ranges of ids, so that order is the order of all documents.

When the documents to come are known, windows that cannot repeat are left out of
the index: a window repeats only if its sampled ``gram``-word string does (see
``windows``). Null texts have no words. See ``repeats`` for copies, ties and null
ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm.common import Scratch, pieces, texts
from korrel.llm.repeats import NOWHERE, Corpus, Seen, candidate_windows, corpus, outcome, repeated, sampled, wanted, word_units
from korrel.llm.windows import gram_hashes, mix

SPAN = 20
GRAM = 8
#: Batches in which a whole table is added to the index.
BATCHES = 3
_SEED = 7
_WINDOWS = pa.schema([("h", pa.int64()), ("check", pa.int64()), ("did", pa.int64()), ("v", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SCHEMA = "h long, check long, did long, v int, start int, end int"


class Index:
    """Runs of (h, check) fingerprints, each bucketed and sorted by both, with their levels."""

    def __init__(self, scratch: Scratch, buckets: int | None = None):
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.levels: list[int] = []

    def write(self, rows: DataFrame, name: str) -> str:
        """Rows that are dealt by (h, check) already, as a table."""
        return self.scratch.bucketed(rows, name, self.buckets, ["h", "check"], ["h", "check"])

    def append(self, fingerprints: DataFrame) -> None:
        """Add fingerprints (h, check) that no run has as a new run; runs of one level are merged."""
        self.runs.append(self.write(fingerprints, "run"))
        self.levels.append(0)
        while self.levels[-2:-1] == self.levels[-1:]:
            self._merge()

    def _merge(self) -> None:
        """The two last runs as one of the next level."""
        old = self.runs[-2:]
        a, b = self.spark.table(old[0]), self.spark.table(old[1]).select(F.col("h").alias("h2"), F.col("check").alias("check2"))
        every = a.join(b.hint("merge"), (a.h == b.h2) & (a["check"] == b.check2), "full")
        self.runs[-2:] = [self.write(every.select(F.coalesce("h", "h2").alias("h"), F.coalesce("check", "check2").alias("check")), "run")]
        self.levels[-2:] = [self.levels[-1] + 1]
        for name in old:
            self.scratch.drop_table(name)

    def compact(self) -> None:
        """Merge all runs into one."""
        while len(self.runs) > 1:
            self._merge()

    def known(self, batch: DataFrame) -> DataFrame:
        """``batch`` with a column ``known``: whether a run has its (h, check)."""
        known = F.lit(False)
        for i, name in enumerate(self.runs):
            run = self.spark.table(name).select(F.col("h").alias("rh"), F.col("check").alias("rc"), F.lit(True).alias(f"in{i}")).hint("merge")
            batch = batch.join(run, (F.col("h") == F.col("rh")) & (F.col("check") == F.col("rc")), "left").drop("rh", "rc")
            known = known | F.coalesce(F.col(f"in{i}"), F.lit(False))
        return batch.withColumn("known", known).drop(*(f"in{i}" for i in range(len(self.runs))))

    def drop(self) -> None:
        for name in self.runs:
            self.scratch.drop_table(name)
        self.runs, self.levels = [], []


def split(text: str) -> list[bytes]:
    """Runs of other than ASCII white space."""
    return text.encode().split()


def checks(words: list[bytes], flat: np.ndarray, span: int) -> np.ndarray:
    """A hash of the bytes of each of the windows that start at the words ``flat``."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[flat].tolist(), ends[flat + span - 1].tolist(), strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b], _SEED) for a, b in spans), dtype=np.uint64, count=len(flat))


def _windows(span: int, gram: int):
    """A row for each window the task has first; rows with null ``check`` are intervals it knows to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in pieces(batch, limit=4 << 20):
                dids, vs = part.column("did").to_pylist(), part.column("v").to_pylist()
                bodies = texts(part)
                places = wanted(part) if "found" in part.schema.names else None
                got = []
                for i in sorted(range(len(dids)), key=lambda i: (dids[i], vs[i])):
                    found = split(bodies[i])
                    units = word_units(found)
                    if places is None:
                        flat = np.arange(max(0, len(units) - span + 1))
                    else:
                        flat = candidate_windows(units, places[i].get(vs[i], NOWHERE), span, gram)[2]
                    if len(flat):
                        got.append((flat, gram_hashes(units, span)[flat], checks(found, flat, span), np.full(len(flat), dids[i], dtype=np.int64), np.full(len(flat), vs[i], dtype=np.int32)))
                if not got:
                    continue
                flat, h, check, did, v = (np.concatenate(x) for x in zip(*got, strict=True))
                again = seen.repeats(mix(h + check), int(did[0]), int(did[-1]))
                new, old = np.flatnonzero(~again), np.flatnonzero(again)
                yield _rows(h[new].view(np.int64), pa.array(check[new].view(np.int64)), did[new], v[new], flat[new], flat[new] + span)
                if len(old):
                    start, end, d, w = flat[old], flat[old] + span, did[old], v[old]
                    cut = np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (start[1:] > end[:-1])))
                    first = np.flatnonzero(cut)
                    last = np.concatenate((first[1:] - 1, [len(old) - 1]))
                    spread = mix(mix(d[first].astype(np.uint64)) + start[first].astype(np.uint64)).view(np.int64)
                    yield _rows(spread, pa.nulls(len(first), pa.int64()), d[first], w[first], start[first], end[last])

    return run


def _rows(h, check, did, v, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h), check, pa.array(did), pa.array(v), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=_WINDOWS)


def add(index: Index, docs: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM, last: bool = False) -> DataFrame:
    """Add documents (did, v, text[, found]) as one batch; their repeats as (did, v, start, end) in words.

    With ``found``, the sampled positions whose strings repeat anywhere, only
    windows around those are looked up and indexed. After the ``last`` batch the index
    is not asked again and stays as it was.
    """
    rows = index.known(docs.mapInArrow(_windows(span, gram), _SCHEMA).repartition(index.buckets, "h", "check"))
    order = Window.partitionBy("h", "check").orderBy("did", "v", "start")
    rows = rows.withColumn("again", F.col("check").isNull() | F.col("known") | (F.row_number().over(order) > 1)).drop("known")
    if last:
        return scratch.keep(rows.filter("again").select("did", "v", "start", "end"), "cuts")
    batch = index.write(rows, "batch")
    rows = scratch.spark.table(batch)
    index.append(rows.filter(~F.col("again")).select("h", "check").distinct())  # dealt so already: no shuffle
    cuts = scratch.keep(rows.filter("again").select("did", "v", "start", "end"), "cuts")
    scratch.drop_table(batch)
    scratch.release()
    return cuts


def intervals(own: Corpus, span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(did, v, start, end): words covered by a window that starts earlier in the corpus."""
    scratch = own.scratch
    found = scratch.keep(repeated(own.texts.select("did", "v", "text"), sampled(lambda text: word_units(split(text)), span, gram)), "found")
    scratch.release()
    bounds = own.texts.agg(F.percentile_approx("did", [i / batches for i in range(1, batches)], 10_000).alias("q")).first().q or []
    edges = [None, *sorted(set(bounds)), None]
    index = Index(scratch)
    out = None
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            inside = F.lit(True)
            if low is not None:
                inside &= F.col("did") > low
            if high is not None:
                inside &= F.col("did") <= high
            docs = own.texts.select("did", "v", "text").filter(inside).join(found.filter(inside), "did")
            cuts = add(index, docs, scratch, span, gram, last=high is None)
            out = cuts if out is None else out.unionByName(cuts)
    finally:
        index.drop()
    scratch.drop(found)
    return out


def kept(text: str, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    words = text.encode().split()
    out: list[bytes] = []
    at = 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out += words[at:a]
        at = b
    return out + words[at:]


_OUT = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256[, kept]) of each row of ``docs``.

    ``row`` holds the columns other than the text; ``kept`` is the text as it was
    where nothing goes, else the kept words with one space between.
    """

    def finish(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple:
        words = kept(text, starts, ends)
        rest = b" ".join(words)
        removed = int((ends - starts).sum())
        return len(words) + removed, removed, hashlib.sha256(rest).hexdigest(), (rest.decode() if removed else text) if with_text else ""

    with corpus(docs) as own:
        cuts = intervals(own, span, gram, batches)
        found = outcome(own, cuts, finish, span, _OUT, "t1 long, t2 long, id long, n long, n_removed long, kept_sha256 string, kept string")
        copy = (F.col("id") != F.col("first")) & (F.col("n") >= span)
        out = found.select(
            "row",
            F.col("n").alias("n_words"),
            F.when(copy, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
        )
        return own.scratch.keep(out, "out")
