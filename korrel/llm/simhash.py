"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is two 32-bit halves. Two fingerprints that differ in at
most ``3`` bits agree up to one bit in at least one half. On a half, the anchors
are the words of a perfect code: the [31, 26] Hamming code times one free bit.
Its covering radius is 1, so every half has a *home* anchor within one bit, and
a half within one bit of it lies within 1 + 1 = 2 bits of that anchor. Each
fingerprint is therefore replicated to every anchor within two bits of each half
(16.5 a half on average) and, per anchor, the members at home are compared with
all others. No pair is missed.

Equal fingerprints are one node, so a group of copies costs one row. Per anchor
only a spanning forest of the links leaves the task, never all pairs; an anchor
with many members is first divided by four 16-bit blocks, one of which any linked
pair shares. If it has very many, its rows pass through to a second round, dealt by
anchor and block, so that several tasks compare them.

Null and empty texts have fingerprint 0 and are linked like others. Repeated rows
get a row each. Null ids stay null and take the component of their fingerprint,
whose least non-null id names it (null if there is none). Extra columns are not
read. An empty table gives no rows; a text of any length is hashed whole, in chunks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import Scratch, by_row, components, look_up
from korrel.llm.windows import mix

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Members of one anchor above which they are divided by 16-bit blocks first.
DIVIDE = 2048
#: Members of one anchor from which other tasks compare them, by anchor and block.
DEFER = 1 << 16
_CHUNK = 1 << 16

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("t", pa.int64())])
_REPLICAS = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])
#: Links (block -1), or rows for the second round: a fingerprint and the hash of an anchor and a block.
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("block", pa.int32())])


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return digest(joined, SEED)  # one shingle: its bits are in the majority
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1

    def hashes() -> Iterator[np.ndarray]:
        for at in range(0, n, _CHUNK):
            spans = zip(starts[at : min(at + _CHUNK, n)].tolist(), ends[at + SHINGLE - 1 : at + _CHUNK + SHINGLE - 1].tolist(), strict=False)
            yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")

    return majority(hashes())


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the unsigned 64-bit hashes have."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, t): fingerprint and hash of the text, as signed longs, for each row of ``docs``."""

    def row(text: str | None) -> tuple[int, int]:
        return _signed(simhash(text)), _signed(xxhash.xxh64_intdigest((text or "").encode(), SEED))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_row(_FINGERPRINTS, row), "doc_id long, fp long, t long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    for i in range(1, 32):
        out ^= np.where(words >> np.uint64(i - 1) & np.uint64(1), np.uint64(i), np.uint64(0))
    return out


#: For each syndrome, the sets of one or two of the 31 positions that it can come from.
_PAIRS = [[(i, i ^ s) for i in range(1, 32) if i < i ^ s] if s else [] for s in range(32)]


def _bit(i: np.ndarray) -> np.ndarray:
    return np.where(i > 0, np.uint64(1) << (np.maximum(i, np.uint64(1)) - np.uint64(1)), np.uint64(0))


_PATTERNS = [np.array([(1 << i - 1) | (1 << j - 1) for i, j in p], dtype=np.uint64) for p in _PAIRS]
_FREE = np.uint64(1 << 31)


def home(halves: np.ndarray) -> np.ndarray:
    """The anchor within one bit of each 32-bit value."""
    return halves ^ _bit(_syndromes(halves & np.uint64(0x7FFFFFFF)))


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every anchor within two bits of each 32-bit value."""
    near = home(halves)
    syndromes = _syndromes(halves & np.uint64(0x7FFFFFFF))
    every = np.arange(len(halves))
    index, found = [every, every], [near, near ^ _FREE]
    for s in range(1, 32):
        mine = np.flatnonzero(syndromes == s)
        if len(mine):
            index.append(np.repeat(mine, len(_PATTERNS[s])))
            found.append((halves[mine][:, None] ^ _PATTERNS[s][None, :]).ravel())
    return np.concatenate(index), np.concatenate(found)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for side in (0, 1):
            halves = (fps >> np.uint64(32)) if side else (fps & np.uint64(0xFFFFFFFF))
            index, found = anchors(halves)
            yield pa.RecordBatch.from_arrays([pa.array((found | np.uint64(side << 32)).astype(np.int64)), pa.array(fps[index].view(np.int64))], schema=_REPLICAS)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is within ``DISTANCE`` bits, a spanning forest of them.

    In a large group only pairs with an equal 16-bit block are tried, which any
    pair within three bits has in one of the four blocks.
    """
    if len(fps) > DIVIDE:
        out: list[tuple[int, int]] = []
        for shift in (0, 16, 32, 48):
            block = fps >> np.uint64(shift) & np.uint64(0xFFFF)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for group in np.split(fps[order], cuts):
                if len(group) > 1:
                    out += _spread(group)
        return out
    return _spread(fps)


def _spread(rest: np.ndarray) -> list[tuple[int, int]]:
    out = []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 64):
                reached |= (np.bitwise_count(front[at : at + 64, None] ^ rest[None, :]) <= DISTANCE).any(axis=0)
            front, rest = rest[reached], rest[~reached]
            out += [(int(root), x) for x in front.tolist()]
    return out


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _compare(batches: Iterator[pa.RecordBatch], defer: bool = True) -> Iterator[pa.RecordBatch]:
    """Links of sorted (anchor, fp) rows; a spanning forest of the whole task's."""
    union = _Union()
    key, members, held = None, [], 0  # the anchor whose rows still come

    def close() -> None:
        if members and held > 1:
            for a, b in forest(np.concatenate(members)):
                union.join(a, b)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        if keys[0] != key:
            close()
            key, members, held = keys[0], [], 0
        if len(starts) > 1:  # the open anchor ends, others lie between, the last one stays open
            if held <= DEFER or not defer:
                members.append(fps[: sizes[0]])
                held += int(sizes[0])
                close()
            else:
                yield _deferred(key, fps[: sizes[0]])
            inner, lengths = starts[1:-1], sizes[1:-1]
            pair = inner[lengths == 2]
            close_by = np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= DISTANCE
            for a, b in zip(fps[pair[close_by]].tolist(), fps[pair[close_by] + 1].tolist(), strict=True):
                union.join(a, b)
            for start, size in zip(inner[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                for a, b in forest(fps[start : start + size]):
                    union.join(a, b)
            key, members, held = keys[-1], [], 0
        rest = fps[starts[-1] :]
        if defer and held + len(rest) > DEFER:
            yield from (_deferred(key, x) for x in (*members, rest))
            members = []
        else:
            members.append(rest)
        held += len(rest)
    if held <= DEFER or not defer:
        close()
    found = [(x, r) for x in list(union.up) if (r := union.root(x)) != x]
    for at in range(0, len(found), 1 << 16):
        ends = np.array(found[at : at + (1 << 16)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(np.full(len(ends), -1, dtype=np.int32))], schema=_EDGES)


def _deferred(anchor: int, fps: np.ndarray) -> pa.RecordBatch:
    """Rows of an anchor for the second round, one for each 16-bit block."""
    blocks = np.repeat(np.arange(4, dtype=np.uint64), len(fps))
    every = np.tile(fps, 4)
    value = every >> blocks * np.uint64(16) & np.uint64(0xFFFF)
    keys = mix(mix(np.full(len(every), anchor, dtype=np.int64).view(np.uint64)) + (value << np.uint64(2) | blocks))
    return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(blocks.astype(np.int32))], schema=_EDGES)


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect the distinct values of column ``fp`` as all links would."""
    replicas = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    found = replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long, block int")
    found = scratch.keep(found, "links")
    edges, rest = found.filter("block < 0").select("a", "b"), found.filter("block >= 0").select(F.col("b").alias("key"), F.col("a").alias("fp"))
    if rest.isEmpty():
        return edges
    again = rest.repartition("key").sortWithinPartitions("key").mapInArrow(functools.partial(_compare, defer=False), "a long, b long, block int")
    return edges.unionByName(again.select("a", "b"))


def _roots(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with the root of each one's component."""
    roots = components(links(nodes, scratch), scratch)
    return nodes.join(roots, nodes.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, n_copies) for each row of ``docs``.

    ``component_id`` is the least doc_id reachable over links of at most three
    bits, ``n_copies`` the number of rows with the same fingerprint.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs).drop("t"), "fingerprints")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "nodes")
    named = scratch.keep(_roots(nodes, scratch), "named")
    least = scratch.keep(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labels = look_up(named, "root", least, "root", "component_id", named.count()).select("fp", F.struct("component_id", "n_copies").alias("label"))
    labels = scratch.keep(labels, "labels")
    return look_up(rows, "fp", labels, "fp", "label", rows.count()).select("doc_id", "fp", "label.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they were: the one with the least
    id, null ids last, and of equal ids the least hash of the text."""
    scratch = Scratch(docs.sparkSession)
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = scratch.keep(fingerprints(docs).select(did.alias("did"), "fp", "t"), "fingerprints")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min(F.struct("did", "t")).alias("least")), "nodes")
    kept = scratch.keep(_roots(nodes, scratch).groupBy("root").agg(F.min("least").alias("least")).select("least.*"), "kept")
    return keep_rows(docs, kept, not rows.groupBy("did", "t").count().filter("count > 1").isEmpty())


def _id_and_hash() -> tuple[Column, Column]:
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return did, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def rows_of(docs: DataFrame) -> DataFrame:
    """(did, t, text) of each row: the id, null ids last, and the hash of the text."""
    did, t = _id_and_hash()
    return docs.select(did.alias("did"), t.alias("t"), F.col("text").cast("string").alias("text"))


def keep_rows(docs: DataFrame, kept: DataFrame, repeated: bool) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by (did, t), one of each if rows are ``repeated``."""
    did, text = _id_and_hash()
    kept = kept.select(F.col("did").alias("korrel_did"), F.col("t").alias("korrel_t"))
    out = docs.join(kept, (did == F.col("korrel_did")) & (text == F.col("korrel_t")), "left_semi")
    if repeated:
        out = out.withColumns({"korrel_did": did, "korrel_t": text}).dropDuplicates(["korrel_did", "korrel_t"]).drop("korrel_did", "korrel_t")
    return out


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
