"""Document fingerprints: threshold-scaled sketches.

A sketch holds every distinct shingle hash below a threshold: the highest of 1, 1/2,
1/4 ... 1/SCALE of the hash range that leaves at most ``whole`` hashes, or the lowest.
So a text of up to ``whole`` different shingles is held whole, a longer one by about
half as many hashes or more, a very long one by one hash in ``SCALE``, so that there the
size follows the document.

Two sketches are compared below the lower of their thresholds: the share of one's
hashes there that the other has estimates containment, with a standard error of at
most about 1 / sqrt(2 * whole) while all hashes of the first sketch count. If both are
whole, it is the containment itself, up to collisions of 48-bit hashes. A short text
has few or no hashes below the threshold of a long one; there all hashes of the
second text decide, which the query has at hand. The threshold follows from the hashes:
more than ``FEW`` of them below half of the range are no accident.

The sketch of joined texts' shingles is the union of their sketches below the lowest
of their thresholds, cut again if it is too large, so merging gives what sketching
all shingles at once would.

Words are runs of other than ASCII white space with A-Z in lower case, shingles
are five words; fewer words are one shingle, no word is one fixed shingle. Null
texts count as empty. Rows are ordered by descending id, null ids last, equal ids
by a hash of the text; the next document of a sole row is itself. Repeated rows
get a row each, extra columns are not read. An empty table gives no rows;
a text of any length is read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import pieces
from korrel.llm.windows import gram_hashes, mix

SHINGLE = 5
#: One in this many shingle hashes is below the lowest threshold; a power of two.
SCALE = 8
#: Different shingles up to which a text is held whole.
WHOLE = 5000
#: So few hashes are a whole sketch; scaled ones have about ``whole`` / 2 or more.
FEW = 64
#: Bytes of a hash that a fingerprint shows, from the highest.
WIDTH = 6
_RANGE = 1 << 8 * WIDTH


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    words = (text or "").encode().lower().split()
    units = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    hashes = gram_hashes(units, min(SHINGLE, len(units))) if len(units) else mix(np.zeros(1, dtype=np.uint64))
    hashes >>= np.uint64(64 - 8 * WIDTH)
    return np.unique(hashes)


def sketch(text: str | None, whole: int = WHOLE) -> np.ndarray:
    """The sorted sketch of a text."""
    return _cut(shingles(text), whole)


def _below(hashes: np.ndarray, parts: int) -> np.ndarray:
    return hashes[: np.searchsorted(hashes, np.uint64(_RANGE // parts))] if parts > 1 else hashes


def _cut(hashes: np.ndarray, whole: int, parts: int = 1) -> np.ndarray:
    """Sorted hashes below the highest threshold, of one in ``parts`` at most, that leaves at most ``whole``."""
    hashes = _below(hashes, parts)
    while parts < SCALE and len(hashes) > whole:
        parts *= 2
        hashes = _below(hashes, parts)
    return hashes


def _scaled(hashes: np.ndarray, whole: int = WHOLE) -> np.ndarray:
    return _cut(np.unique(hashes), whole)


def parts_of(hashes: np.ndarray) -> int:
    """How many times a sketch's threshold goes into the hash range."""
    parts = 1
    while parts < SCALE and len(hashes) > FEW and int(hashes[-1]) < _RANGE // (2 * parts):
        parts *= 2
    return parts


def merge(*sketches: np.ndarray, whole: int = WHOLE) -> np.ndarray:
    """The sketch of all the shingles together."""
    return _cut(np.unique(np.concatenate(sketches)), whole, max(map(parts_of, sketches)))


def containment(a: np.ndarray, b: np.ndarray, every: np.ndarray | None = None) -> float:
    """The share of the first text's shingles that the second has, by their sketches.

    Where the second's threshold is below the first's, ``every`` hash of the second text
    decides; without it only the hashes below both count, and none gives 0.
    """
    if (parts := parts_of(b)) > parts_of(a):
        a, b = (a, every) if every is not None else (_below(a, parts), b)
    return len(np.intersect1d(a, b, assume_unique=True)) / max(len(a), 1)


def show(hashes: np.ndarray) -> str:
    """A sketch as text: fixed-width hexadecimal numbers in ascending order."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8).reshape(-1, WIDTH)
    return np.concatenate([np.zeros((len(raw), 8 - WIDTH), dtype=np.uint8), raw], axis=1).view(">u8").ravel().astype(np.uint64)


def sketches(docs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(doc_id, fingerprint) of each row."""
    _check(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([show(sketch(x, whole)) for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _check(whole: int) -> None:
    if whole < 4 * FEW:
        raise ValueError(f"whole must be at least {4 * FEW}, so that scaled sketches have more than {FEW} hashes")


def edited(text: str, following: str) -> str:
    """A text whose last half is replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(whole: int, doc_id: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    """The row of a text; ``own`` and ``theirs`` are all hashes of the text and of the next."""
    new = edited(text, following)
    other = own if new == text else shingles(new)
    a, b, c = (_cut(x, whole) for x in (own, other, theirs))
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), show(a), show(b), containment(a, b, other), containment(a, c, theirs)


def _with_next(whole: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (part, extra, doc_id, text), sorted, against the next row; a part's extra row only follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in pieces(batch, limit=4 << 20):
                rows = []
                for number, extra, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = shingles(text)
                    if before is not None and before[0] == number:
                        rows.append(_compare(whole, *before[1:], text, own))
                    before = None if extra else (number, doc_id, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _ranges(ids: np.ndarray, hashes: np.ndarray) -> Callable:
    """The number of the range of a row (null, id, t): ids descending between the bounds
    ``ids``, then rows without an id by their text's hash between the bounds ``hashes``.

    Bounds go along as data, however many they are, not as parts of the plan.
    """

    @F.pandas_udf("int")
    def number(null: pd.Series, doc_id: pd.Series, t: pd.Series) -> pd.Series:
        with_id = len(ids) - np.searchsorted(ids, doc_id.to_numpy(), side="left")
        without = len(ids) + 1 + np.searchsorted(hashes, t.to_numpy(), side="left")
        return pd.Series(np.where(null.to_numpy(), without, with_id).astype(np.int32))

    return number


def _bounds(quantiles: list[int] | None, parts: int) -> np.ndarray:
    """About every so many of a column's quantiles, so that there are ``parts`` ranges."""
    found = np.array(sorted(quantiles or []), dtype=np.int64)
    at = [i * (len(found) + 1) // parts - 1 for i in range(1, parts)]
    return np.unique(found[[i for i in at if 0 <= i < len(found)]])


def compare_with_next(docs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Each row's fingerprint against its edited text's and the next document's.

    Ids are cut into ranges, rows without an id into ranges of their texts' hashes;
    each range is sorted in one task, and the first row of
    a range is also sent, as an extra row, behind the range before it. The texts are
    shuffled once.
    """
    _check(whole)
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    no_id, places = F.col("doc_id").isNull(), [i / parts for i in range(1, parts)] or [0.5]
    quantiles = [F.percentile_approx(c, places, 100 * parts) for c in (F.col("doc_id"), F.when(no_id, F.col("t")))]
    n, n_null, ids, hashes = rows.agg(F.count("*"), F.count_if(no_id), *quantiles).first()
    null_parts = min(max(round(parts * n_null / max(n, 1)), 1), parts)
    ids, hashes = _bounds(ids, max(parts - null_parts, 1) if n_null else parts), _bounds(hashes, null_parts)
    rows = rows.withColumn("part", _ranges(ids, hashes)(no_id, F.coalesce("doc_id", F.lit(0)), F.col("t")))
    parts = len(ids) + len(hashes) + 2
    order = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "t")
    firsts = rows.groupBy("part").agg(F.min(F.struct(order.alias("order"), F.col("doc_id"), F.col("t"))).alias("first")).orderBy("part").collect()  # one for each part
    if not firsts:
        return spark.createDataFrame([], COLUMNS)
    heads = [(r.part, r.first.doc_id, r.first.t, firsts[i - 1].part) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(heads, "p int, d long, h long, before int")
    found = rows.join(F.broadcast(heads), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("h")), "left")
    places = F.when(F.col("p").isNull(), F.array(F.struct("part", F.lit(False).alias("extra")))).otherwise(F.array(F.struct("part", F.lit(False).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))))
    found = found.select(F.explode(places).alias("place"), "doc_id", "t", "text").select("place.part", "place.extra", "doc_id", "t", "text")
    sorted_ = found.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "t")
    return sorted_.select("part", "extra", "doc_id", "text").mapInArrow(_with_next(whole), COLUMNS)
