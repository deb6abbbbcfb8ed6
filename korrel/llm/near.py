"""SimHash near-dedup as a stage: one document of each group of near copies.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is ``SIMILAR`` or more; of each component one stays. Candidates come from
two searches, and links are decided by the sets themselves.

The first is the operator's own (see ``simhash``): fingerprints, here of the five-word
shingle sets, are replicated to the anchors of a covering code and compared there.
It finds what is within three bits, the closest copies. At a similarity of 0.8 two
fingerprints differ in 9.7 bits of 64 on average, in up to 19 for one pair in a
thousand, and no covering code serves a radius of 19: each half would have to go to
every anchor within 10 bits, over three million. So the second search, min-hash
signatures, finds the rest: ``BANDS`` bands of ``ROWS`` minima, a pair being a
candidate if a band is equal. A pair at 0.8 is missed with chance
(1 - 0.8 ** 5) ** 40, about one in eight million, a closer one less often.

Documents with the same set are one node. A group of nodes with an equal band is
first linked in chains, each node with the one before it, in a new order each
round, so a large family is joined by few comparisons and has no hot node. Then
every pair of a band's nodes that is in different components still is tried. Pairs are
compared first where the band's nodes meet: by a byte of each of the signatures'
minima, of which ``AGREE`` must be equal, as in all but one in two million of the pairs
at 0.8, then by sketches, the least ``SKETCH`` of 32-bit hashes of the shingles. These
are whole sets up to that size; of larger ones a pair at 0.8 falls short by five standard
deviations once in three million. Only pairs that pass leave the task and are decided by
their sets, so a large family that shares bands, but is less similar, makes few rows of
pairs. A band of more than ``BLOCK`` nodes is dealt to many tasks: in chains by blocks,
for all pairs by pairs of blocks.

Words and short texts are treated as in ``sketch``; null texts count as empty.
Repeated rows and null ids are treated as in ``simhash.keep_one``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm.common import HOT, MOST_HOT, Scratch, components, pieces
from korrel.llm.simhash import keep_rows, links, majority, rows_of
from korrel.llm.windows import gram_hashes, mix

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 5
#: Of so many minima, those in which a pair at 0.8 agrees: five standard deviations below 160.
AGREE = 132
#: Hashes in a sketch; it goes along to where a band's nodes meet.
SKETCH = 512
#: Nodes of a band up to which one task has all of them.
BLOCK = 2048
#: Rounds of chains before all remaining pairs are compared.
CHAINS = 2
_SEED = 42
_CHUNK = 512
_PART = 1 << 16
_XOR = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_TIMES = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)) | np.uint64(1)

_NODES = pa.schema([("did", pa.int64()), ("t", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("bytes", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    units = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unique(gram_hashes(units, min(size, len(units)))) if len(units) else mix(np.zeros(1, dtype=np.uint64))


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` minima of a set's min-hash signature, ``BANDS * ROWS`` at most."""
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = (hashes[at : at + _CHUNK] ^ _XOR[:count, None]) * _TIMES[:count, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's 32-bit hashes, sorted, ``SKETCH`` at most."""
    return np.unique((mix(hashes) >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band of a set's minima, different for different bands."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix(out ^ column)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            sets = [shingles(x) for x in part.column("text").to_pylist()]
            least = [minima(x, BANDS * ROWS) for x in sets]
            keys = [xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([xxhash.xxh64_intdigest((x or "").encode(), _SEED) for x in part.column("text").to_pylist()], pa.uint64()).view(pa.int64()),
                    pa.array(keys, pa.uint64()).view(pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([majority([x[at : at + _PART] for at in range(0, len(x), _PART)]) for x in sets], pa.uint64()).view(pa.int64()),
                    pa.array([bands(x).view(np.int64) for x in least], pa.list_(pa.int64())),
                    pa.array([mix(x).astype(np.uint8).tobytes() for x in least], pa.binary()),
                ],
                schema=_NODES,
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            sets = [shingles(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())], names=["node", "hashes", "sketch"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        close = [similarity(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) >= SIMILAR for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))


def _may(mine: np.ndarray, others: list[np.ndarray], n: int, sizes: np.ndarray) -> np.ndarray:
    """Whether a set may be similar to each of some others, by the sketches and sizes of all."""
    every = np.uint32((1 << 32) - 1)
    ends = np.array([x[-1] for x in others], dtype=np.uint32)  # sketches of larger sets are complete up to their end
    upto = np.minimum(np.where(sizes > SKETCH, ends, every), mine[-1] if n > SKETCH else every)
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    theirs = np.concatenate(others)
    inside = theirs <= upto[owner]
    owner, theirs = owner[inside], theirs[inside]
    equal = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
    both = np.bincount(owner[equal], minlength=len(others))
    union = np.searchsorted(mine, upto, side="right") + np.bincount(owner, minlength=len(others)) - both
    lost = np.maximum(sizes - [len(x) for x in others], 0) + max(n - len(mine), 0)  # by equal hashes, in whole sets
    error = np.where((sizes > SKETCH) | (n > SKETCH), 5 * np.sqrt(SIMILAR * (1 - SIMILAR) * union) + 2, lost)
    return both + error + 1e-6 >= SIMILAR * union


def agreeing(node: np.ndarray, root: np.ndarray, n: np.ndarray, least: np.ndarray, sketches: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Pairs of nodes of different components that may be similar by their sizes, minima and sketches."""
    every = np.arange(len(node))
    for at in range(0, len(node) - 1, 32):
        i = every[at : at + 32, None]
        j = every[None, at + 1 :]
        may = (j > i) & (root[i] != root[j]) & (np.minimum(n[i], n[j]) + 1 >= SIMILAR * np.maximum(n[i], n[j]))
        left, right = np.nonzero(may)
        left, right = left + at, right + at + 1
        for k in range(0, len(left), 1 << 15):
            a, b = left[k : k + (1 << 15)], right[k : k + (1 << 15)]
            kept = np.flatnonzero((least[a] == least[b]).sum(axis=1) >= AGREE)
            a, b = a[kept], b[kept]
            for group in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
                if len(group):
                    x, others = a[group[0]], b[group]
                    others = others[_may(sketches[x], [sketches[y] for y in others], n[x], n[others])]
                    if len(others):
                        yield np.stack([np.full(len(others), node[x]), node[others]], axis=1)


def neighbours(node: np.ndarray, root: np.ndarray, n: np.ndarray, least: np.ndarray, sketches: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The same of each node and the next one only."""
    kept = (root[1:] != root[:-1]) & (np.minimum(n[1:], n[:-1]) + 1 >= SIMILAR * np.maximum(n[1:], n[:-1]))
    kept &= (least[1:] == least[:-1]).sum(axis=1) >= AGREE
    for at in np.flatnonzero(kept):
        if _may(sketches[at], [sketches[at + 1]], n[at], n[at + 1 : at + 2])[0]:
            yield node[None, at : at + 2]


def _alike(batches: Iterator[pa.RecordBatch], pairs: Callable = agreeing) -> Iterator[pa.RecordBatch]:
    """From rows (key, node, root, n, bytes, sketch) sorted by key: pairs of each key that may be similar."""
    held: list[pa.RecordBatch] = []

    def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, root, n = (rows.column(i).to_numpy() for i in range(4))
        least = np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype=np.uint8).reshape(len(key), BANDS * ROWS)
        sketches = [np.frombuffer(x, dtype=np.uint32) for x in rows.column(5).to_pylist()]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            if found := list(pairs(node[a:b], root[a:b], n[a:b], least[a:b], sketches[a:b])):
                ends = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], schema=_PAIRS)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and key[-1] != held[0].column(0)[0].as_py():  # what is held ends in this batch
            cut = int(np.searchsorted(key != held[0].column(0)[0].as_py(), True))
            yield from groups(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, batch, key = [], batch.slice(cut), key[cut:]
        if not held and len(key):
            cut = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
            if cut:
                yield from groups(pa.Table.from_batches([batch.slice(0, cut)]))
            batch = batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield from groups(pa.Table.from_batches(held))


def _close(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes that the anchors bring together: each fingerprint's nodes in a
    chain, and the first nodes of linked fingerprints."""
    chain = Window.partitionBy("fp").orderBy("node")
    same = nodes.select(F.col("node").alias("a"), F.lag("node").over(chain).alias("b")).dropna()
    first = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    found = links(first, scratch)
    for end in ("a", "b"):
        found = found.join(first.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    return scratch.keep(same.unionByName(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))), "close")


def _counted(rows: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """The rows (n of them at most) whose key ``counts`` has, with their key's number of rows, ``many``.

    Keys of more than ``max(HOT, n / 1000)`` rows, at most 1000 or ``n / HOT``, are
    looked up by a broadcast, so that no task gets all rows of a key.
    """
    most = max(HOT, n // MOST_HOT)
    hot = F.broadcast(counts.filter(F.col("many") > most).withColumnRenamed("key", "hot"))
    marked = rows.join(hot, F.col("key") == F.col("hot"), "left")
    cold = marked.filter("hot is null").drop("hot", "many").join(counts.filter(F.col("many") <= most), "key")
    return cold.unionByName(marked.filter("hot is not null").drop("hot").select(cold.columns))


def _cells(live: DataFrame, turn: int, chain: bool) -> DataFrame:
    """``live`` with keys of more than ``BLOCK`` rows split: a row goes to its block, or to all pairs of blocks with its own."""
    blocks = F.ceil(F.col("many") / BLOCK)
    rows = live.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")))
    cell = F.struct(F.col("mine").alias("x"), F.col("mine").alias("y"))
    cells = F.array(cell) if chain else F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct(F.least("mine", i).alias("x"), F.greatest("mine", i).alias("y")))
    rows = rows.withColumn("cell", F.explode(cells))
    return rows.withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "cell.x", "cell.y"))).drop("blocks", "mine", "cell", "many")


def _roots(nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, root) of each node that is not its own root; none if no two nodes may be alike."""
    close = _close(nodes.select("node", "fp"), scratch)
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    counts = scratch.keep(keys.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "counts")
    members = scratch.keep(_counted(keys, counts, nodes.count() * BANDS), "members")
    if members.isEmpty() and close.isEmpty():
        return None
    asked = members.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    some = scratch.keep(nodes.join(asked, "node", "left_semi").select("node", "bytes", F.col("least.did").alias("did"), F.col("least.t").alias("t")), "asked")
    found = rows_of(docs).join(some.drop("bytes"), ["did", "t"]).select("node", "text")
    sets = scratch.keep(found.mapInArrow(_sets, "node long, hashes binary, sketch binary").dropDuplicates(["node"]), "sets")
    facts = some.select("node", "bytes").join(sets.select("node", "sketch"), "node")
    sets, n = sets.select("node", "hashes"), members.count()
    scratch.release()
    tested = links = roots = None
    for turn in range(CHAINS + 1):
        live = members.withColumn("root", F.col("node"))
        if roots is not None:
            live = members.drop("many").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed = live.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("many")).filter("x <> y").select("key", "many")
            live = scratch.keep(_counted(live, scratch.keep(mixed, "mixed"), n), "live")
        dealt = _cells(live, turn, turn < CHAINS).join(facts, "node").select("key", "node", "root", "n", "bytes", "sketch").repartition("key")
        if turn < CHAINS:
            dealt = dealt.sortWithinPartitions("key", F.xxhash64("node", F.lit(turn)), "node")
            pairs = dealt.mapInArrow(functools.partial(_alike, pairs=neighbours), "a long, b long")
        else:
            pairs = dealt.sortWithinPartitions("key").mapInArrow(_alike, "a long, b long")
        pairs = (pairs.unionByName(close) if roots is None else pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = scratch.keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if roots is not None:
            scratch.drop(live)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")
        new = scratch.keep(both.mapInArrow(_linked, "a long, b long"), "links")
        links = new if links is None else links.unionByName(new)
        roots = scratch.keep(components(links, scratch), "roots")
        scratch.release()
    return roots


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they were: the one with the least
    id, null ids last, and of equal ids the least hash of the text."""
    scratch = Scratch(docs.sparkSession)
    rows = rows_of(docs)
    found = scratch.keep(rows.select("did", "text").mapInArrow(_nodes, "did long, t long, node long, n long, fp long, bands array<long>, bytes binary"), "nodes")
    nodes = scratch.keep(found.groupBy("node").agg(F.min(F.struct("did", "t")).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")), "distinct")
    repeated = not found.groupBy("did", "t").count().filter("count > 1").isEmpty()
    scratch.drop(found)
    roots = _roots(nodes, docs, scratch)
    kept = nodes.select("node", "least")
    if roots is not None:
        kept = kept.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    return keep_rows(docs, scratch.keep(kept.select("least.*"), "kept"), repeated)
