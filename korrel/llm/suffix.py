"""Exact repeats of byte strings by distributed prefix doubling.

A rank names the equality class of the bytes from a position on; joining the rank
at a position with the rank one length further names the string of twice the
length. Ranking starts at a quarter of the threshold, at the sampled positions
without which no string of the threshold's length can repeat (see ``windows``).
Round by round Spark sorts (rank, position) rows and drops positions whose rank is
unique: after the first round the strings of a quarter, after the second, at the
offset of one more quarter, the strings of a half that hold a sampled position.
The last round doubles to the full length, at every position around what is left,
and sorts the pairs in document order within their sampled string: every position
but a pair's first is a repeat.

Ranks are 64-bit names that depend on the string alone, so a round needs no
numbering pass; two strings are equal only if both the sampled string's and the
doubled one's name agree.

Null and empty texts and texts shorter than the threshold keep everything. Matches
never cross documents. See ``repeats`` for copies, ties and null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import pieces, texts
from korrel.llm.repeats import NOWHERE, Corpus, Seen, byte_units, corpus, outcome, repeated, sampled, wanted, windows_of
from korrel.llm.windows import anchors, gram_hashes, mix

SPAN = 100
_ROWS = pa.schema([("k", pa.int64()), ("did", pa.int64()), ("v", pa.int32()), ("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.binary())])
_CUTS = pa.schema([("did", pa.int64()), ("v", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def doubled(units: np.ndarray, size: int, span: int) -> np.ndarray:
    """Names of all strings of ``span`` units, from names of ``size`` units by doubling."""
    names = gram_hashes(units, size)
    while size < span:
        step = min(size, span - size)
        names = mix(names[: len(names) - step] * np.uint64(0x9FB21C651E98DF25) + names[step:]) if len(names) > step else names[:0]
        size += step
    return names


def _halves(span: int, gram: int):
    """A ranking by doubled strings: at each place, the string from the position on (0) and the one that ends with its string (1)."""

    def ranks(text: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = byte_units(text).astype(np.uint64)
        names = doubled(units, gram, 2 * gram)
        pos = np.unique(places >> 1)
        right, left = pos[pos < len(names)], pos[pos >= gram]
        return np.concatenate((names[right], mix(names[left - gram]))), np.concatenate((right << 1, left << 1 | 1))

    return ranks


def _admissible(units: np.ndarray, places: np.ndarray, span: int, gram: int):
    """Anchors with those of their windows whose doubled strings all are among the places."""
    pos, hashes, first, last = anchors(units, span, gram)
    right, left = np.isin(pos << 1, places), np.isin(pos << 1 | 1, places)
    # A window that starts ``o`` bytes before the position holds the string to the
    # right if o <= span - 2 * gram, the one to the left if o >= gram.
    low = np.where(right & ~left, np.maximum(first, pos - gram + 1), first)
    high = np.where(left & ~right, np.minimum(last, pos - (span - 2 * gram) - 1), last)
    keep = (right | left) & (low <= high)
    return windows_of(pos[keep], hashes[keep], low[keep], high[keep])


def _contexts(span: int, gram: int):
    """Rows for the second sort: bytes around each repeated position, and what the task already knows to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in pieces(batch, limit=4 << 20):
                dids, vs = part.column("did").to_pylist(), part.column("v").to_pylist()
                bodies, places = texts(part), wanted(part)
                order = sorted(range(len(dids)), key=lambda i: (dids[i], vs[i]))
                got, datas = [], []
                for i in order:
                    data = bodies[i].encode()
                    units = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
                    pos, hashes, flat, sizes = _admissible(units, places[i].get(vs[i], NOWHERE), span, gram)
                    if len(pos):
                        got.append((pos, hashes, flat, sizes, doubled(units, gram, span)[flat], np.full(len(pos), len(datas)), np.full(len(pos), dids[i], dtype=np.int64), np.full(len(pos), vs[i], dtype=np.int32)))
                        datas.append(data)
                if not got:
                    continue
                pos, hashes, flat, sizes, names, number, did, v = (np.concatenate(x) for x in zip(*got, strict=True))
                again = seen.repeats(names, int(did[0]), int(did[-1]))
                begin = np.cumsum(sizes) - sizes
                far = np.iinfo(np.int64).max
                low = np.minimum.reduceat(np.where(again, far, flat), begin)
                high = np.maximum.reduceat(np.where(again, -1, flat), begin)
                new = np.flatnonzero(high >= 0)
                contexts = [datas[n][a : b + span] for n, a, b in zip(number[new].tolist(), low[new].tolist(), high[new].tolist(), strict=True)]
                yield _rows(hashes[new].view(np.int64), did[new], v[new], pos[new], low[new], np.zeros(len(new)), pa.array(contexts, pa.binary()))
                low = np.minimum.reduceat(np.where(again, flat, far), begin)
                high = np.maximum.reduceat(np.where(again, flat, -1), begin)
                old = np.flatnonzero(high >= 0)
                if len(old):  # neighbours' intervals are joined
                    start, end, doc = low[old], high[old] + span, number[old]
                    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])))
                    first = np.flatnonzero(cut)
                    last = np.concatenate((first[1:] - 1, [len(old) - 1]))
                    spread = mix(mix(did[old][first].astype(np.uint64)) + start[first].astype(np.uint64)).view(np.int64)
                    yield _rows(spread, did[old][first], v[old][first], pos[old][first], start[first], end[last], pa.nulls(len(first), pa.binary()))

    return run


def _rows(k, did, v, pos, start, end, context) -> pa.RecordBatch:
    arrays = [pa.array(k), pa.array(did), *(pa.array(np.asarray(x).astype(np.int32)) for x in (v, pos, start, end)), context]
    return pa.RecordBatch.from_arrays(arrays, schema=_ROWS)


def _first_of_each(span: int, gram: int):
    """From rows sorted by (k, did, v, pos): intervals of windows that an earlier row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_k, open_names = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            for part in pieces(batch, "context", 4 << 20):
                known = part.filter(pa.compute.is_null(part.column("context")))
                if known.num_rows:
                    yield pa.RecordBatch.from_arrays([known.column(x) for x in ("did", "v", "start", "end")], schema=_CUTS)
                part = part.filter(pa.compute.is_valid(part.column("context")))
                if not part.num_rows:
                    continue
                k = part.column("k").to_numpy()
                lengths = pa.compute.binary_length(part.column("context")).to_numpy().astype(np.int64)
                body = np.frombuffer(b"".join(part.column("context").to_pylist()), dtype=np.uint8).astype(np.uint64)
                sizes = lengths - span + 1
                begin = np.cumsum(lengths) - lengths
                inner = np.cumsum(sizes) - sizes
                offset = np.arange(sizes.sum()) - np.repeat(inner, sizes)
                names = mix(doubled(body, gram, span)[np.repeat(begin, sizes) + offset] + np.repeat(k.view(np.uint64), sizes) * np.uint64(0x9E3779B97F4A7C15))
                _, index = np.unique(names, return_index=True)
                again = np.ones(len(names), dtype=bool)
                again[index] = False
                lasts = k == k[-1]
                at_last = names[np.repeat(lasts, sizes)]
                if k[0] == open_k:
                    head = np.repeat(k == open_k, sizes)
                    again[head] |= np.isin(names[head], open_names)
                    open_names = np.union1d(open_names, at_last) if k[-1] == open_k else np.unique(at_last)
                else:
                    open_names = np.unique(at_last)
                open_k = k[-1]
                far = np.iinfo(np.int64).max
                low = np.minimum.reduceat(np.where(again, offset, far), inner)
                high = np.maximum.reduceat(np.where(again, offset, -1), inner)
                rows = np.flatnonzero(high >= 0)
                start = part.column("start").to_numpy()
                some = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([some.column("did"), some.column("v"), pa.array((start[rows] + low[rows]).astype(np.int32)), pa.array((start[rows] + high[rows] + span).astype(np.int32))], schema=_CUTS)

    return run


def intervals(own: Corpus, span: int) -> DataFrame:
    """(did, v, start, end): bytes covered by a string of ``span`` bytes that starts earlier."""
    if span < 4:
        raise ValueError("strings must have 4 bytes or more")
    gram = span // 4
    found = repeated(own.texts.select("did", "v", "text"), sampled(byte_units, span, gram))
    found = own.scratch.keep(found, "quarters")
    own.scratch.release()
    found = repeated(own.texts.select("did", "v", "text").join(found, "did"), _halves(span, gram))
    near = own.texts.select("did", "v", "text").join(found, "did").mapInArrow(_contexts(span, gram), "k long, did long, v int, pos int, start int, end int, context binary")
    return near.repartition("k").sortWithinPartitions("k", "did", "v", "pos").mapInArrow(_first_of_each(span, gram), "did long, v int, start int, end int")


def kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(data[at:a])
        at = b
    return b"".join((*out, data[at:]))


_OUT = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, span: int = SPAN, with_bytes: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row of ``docs``.

    ``row`` holds the columns other than the text.
    """

    def finish(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple:
        data = text.encode()
        rest = kept(data, starts, ends)
        return len(data), len(data) - len(rest), len(starts), hashlib.sha256(rest).hexdigest(), rest if with_bytes else b""

    with corpus(docs) as own:
        cuts = own.scratch.keep(intervals(own, span), "cuts")
        own.scratch.release()
        columns = "t1 long, t2 long, id long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        found = outcome(own, cuts, finish, span, _OUT, columns)
        copy = (F.col("id") != F.col("first")) & (F.col("n") >= span)
        out = found.select(
            "row",
            F.col("n").alias("n_bytes"),
            F.when(copy, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_bytes else []),
        )
        return own.scratch.keep(out, "out")
