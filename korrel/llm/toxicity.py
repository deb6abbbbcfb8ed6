"""Toxic spans by a linear-chain conditional random field.

A document's labels become token labels: in a toxic training document the tokens
whose word is much more frequent in toxic than in other documents are toxic, all
other tokens are clean. Word counts cover all training documents (one row per
distinct text, so copies count once, and near copies, toxic or not, together about
once: each counts by one over the size of its family); a word enters the lexicon if
a Chernoff bound on its count leaves less than about one chance word in the whole
vocabulary, all such words whatever their number. Beginnings of words, ``PREFIXES``
letters long, are counted and enter like words, so that forms of a toxic word that
training has not seen are found by what they begin with; one needs that evidence from
other words than its most common one. A word that several entries
fit counts as the most evident of them. The field has two states, one weight per
lexicon entry, one for all other words, and transitions. Its weights are fitted on at most ``SAMPLE`` whole
documents, half of them toxic. Between lexicon words the tokens are alike, so a
gap of any length is one closed-form matrix power: forward and backward passes
are exact over whole texts and cost only what the lexicon words cost.

The expected number of toxic tokens, from the marginals, becomes the document's
score by a logistic curve fitted on the same sample and weighted to the true
share of toxic documents.

Null and empty texts, and texts without a lexicon word, have no toxic token and
get the curve's value at zero. Training rows need a non-null id and label;
several labels of one id count as toxic if one is. Without any training row of
both kinds every score is the share of toxic rows (0 if there are no rows).
Repeated rows are scored each; extra columns are not read. An empty table gives no
rows; texts of any length are tagged whole.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import Scratch, pieces, texts
from korrel.llm.near import minima, shingles

#: Most training documents that the field's weights are fitted on.
SAMPLE = 4000
#: Least odds ratio, of toxic against other documents, of a word in the lexicon.
ODDS = 5.0
#: The same bound for the evidence of a beginning's other words: a chance of one in twenty, as one entry is tested.
GENERAL = math.log(20)
#: A document's family: those that share this many of so many min-hashes of its three-word shingles.
AGREE, MINIMA, SHINGLE = 3, 8, 3
#: What a document counts that has no near copy; whole numbers, so that sums keep to no order.
_UNIT = 1 << 20
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Words counted by a task before it hands the counts on.
_HELD = 300_000
#: Letters of the beginnings of words that are counted beside whole words.
PREFIXES = (3, 4, 5, 6)
#: Words whose entry a worker remembers.
_REMEMBERED = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def entries(words: Iterable[str]) -> set[str]:
    """Words and the beginnings of longer ones, which end with a star."""
    words = set(words)
    return words.union(*([w[:k] + "*" for w in words if len(w) > k] for k in PREFIXES))


class _Numbers(dict):
    """The lexicon entry of each word, the most evident of those that fit; -1 if none does."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = number = min((self.lexicon[x] for x in entries([word]) if x in self.lexicon), default=-1)
        return number


def folded(text: str) -> tuple[str, list[int] | None]:
    """Lower case, and the original place of each character if lengths differ."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p] + [len(text)]


@dataclass
class Field:
    """Weights of the field and of the curve from toxic tokens to a score."""

    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of a word outside the lexicon in the toxic state; of clean-toxic, toxic-clean and toxic-toxic neighbours.
    shared: np.ndarray = field(default_factory=lambda: np.array([-5.0, -2.0, 0.0, 1.0]))
    slope: float = 0.0
    level: float = -20.0

    @functools.cached_property
    def numbers(self) -> _Numbers:
        return _Numbers(self.words)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "numbers"}

    def score(self, toxic_tokens: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(toxic_tokens) + self.level, -40, 40)))


def _passes(gaps: np.ndarray, hot: np.ndarray, shared: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """log Z of each row and the toxic marginal of each lexicon word.

    gaps: (rows, m + 1) numbers of other words before, between and after; hot:
    (rows, m) weights of the lexicon words, NaN past a row's last one. A clean
    token is taken to precede the text.
    """
    other, enter, leave, stay = shared
    move = np.array([[1.0, math.exp(enter)], [math.exp(leave), math.exp(stay)]])
    step = move * np.array([1.0, math.exp(other)])
    mid, half = (step[0, 0] + step[1, 1]) / 2, math.sqrt(((step[0, 0] - step[1, 1]) / 2) ** 2 + step[0, 1] * step[1, 0])
    most, ratio = mid + half, (mid - half) / (mid + half)
    lasting = (step - (mid - half) * np.eye(2)) / (2 * half)
    passing = np.eye(2) - lasting
    rows, m = hot.shape
    power = lambda g: lasting + (np.asarray(ratio) ** g)[:, None, None] * passing  # noqa: E731  over most ** g

    present = ~np.isnan(hot)
    weight = np.exp(np.clip(np.where(present, hot, 0.0), -40, 40))
    total = gaps.sum(axis=1) * math.log(most)
    ahead = np.zeros((m, rows, 2))
    now = np.tile([1.0, 0.0], (rows, 1))
    for t in range(m):
        new = np.einsum("ri,rij->rj", now, power(gaps[:, t])) @ move
        new[:, 1] *= weight[:, t]
        scale = new.sum(axis=1)
        now = np.where(present[:, t, None], new / scale[:, None], now)
        total += np.where(present[:, t], np.log(scale), 0.0)
        ahead[t] = now
    end = np.einsum("ri,rij->rj", now, power(gaps[np.arange(rows), present.sum(axis=1)]))
    total += np.log(end.sum(axis=1))
    if not both:
        return total, None
    marginals = np.zeros((rows, m))
    back = np.ones((rows, 2))
    filled = present.sum(axis=1)
    for t in range(m - 1, -1, -1):
        here = np.einsum("rij,rj->ri", power(gaps[:, t + 1]), back)
        last = filled == t + 1
        here = np.where(last[:, None], power(gaps[:, t + 1]).sum(axis=2), here)
        both_ways = ahead[t] * here
        marginals[:, t] = np.where(present[:, t], both_ways[:, 1] / both_ways.sum(axis=1), 0.0)
        back = here * np.stack([np.ones(rows), weight[:, t]], axis=1) @ move.T
        back /= back.sum(axis=1, keepdims=True)
    return total, marginals


def _padded(found: list[tuple[list[int], list[int]]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaps, word numbers (-1 past the end) and weights of rows of (gaps, words)."""
    m = max(len(w) for _, w in found)
    gaps, words = np.zeros((len(found), m + 1)), np.full((len(found), m), -1)
    for i, (g, w) in enumerate(found):
        gaps[i, : len(g)] = g
        words[i, : len(w)] = w
    return gaps, words, np.where(words >= 0, weights[words] if len(weights) else 0.0, np.nan)


def sequence(words: list[str], numbers: _Numbers) -> tuple[list[int], list[int]]:
    """The lexicon entries of a text's words and the numbers of other words around them."""
    found = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    at = np.flatnonzero(found >= 0)
    return (np.diff(np.concatenate(([-1], at, [len(words)]))) - 1).tolist(), found[at].tolist()


def fit(samples: list[tuple[int, list[int], list[int]]], start: np.ndarray, share: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights, shared weights, slope and level from (toxic, gaps, words) rows.

    Penalised likelihood, by steps whose sizes follow the gradient's signs. A word
    that is in none of the rows keeps its weight in ``start``, from all documents.
    ``share``: the true share of toxic documents.
    """
    weights, shared = start.copy(), Field().shared.copy()
    order = sorted(samples, key=lambda x: len(x[2]))
    groups = []
    at = 0
    while at < len(order):  # rows of like length together
        to = at
        while to < len(order) and len(order[to][2]) <= 2 * len(order[at][2]) + 4:
            to += 1
        groups.append((np.array([x[0] for x in order[at:to]]), *_padded([(x[1], x[2]) for x in order[at:to]], weights)[:2]))
        at = to

    def likelihood(weights: np.ndarray, shared: np.ndarray, gradient: bool) -> tuple[float, np.ndarray]:
        value = -0.005 * ((weights - start) ** 2).sum() - 0.02 * (shared**2).sum()
        slopes = -0.01 * (weights - start)
        for toxic, gaps, words in groups:
            hot = np.where(words >= 0, weights[words], np.nan)
            z, p = _passes(gaps, hot, shared, gradient)
            y = (words >= 0) & (toxic[:, None] == 1)
            value -= z.sum()
            # The labelled path: lexicon words of toxic documents are toxic, the rest clean.
            value += np.where(y, hot, 0.0).sum()
            joined = np.zeros(y.shape, dtype=bool)
            joined[:, 1:] = y[:, 1:] & y[:, :-1] & (gaps[:, 1:-1] == 0)
            follows = np.zeros(y.shape, dtype=bool)
            follows[:, :-1] = joined[:, 1:]
            filled = (words >= 0).sum(axis=1)
            ends = np.zeros(y.shape, dtype=bool)
            ends[np.flatnonzero(filled), filled[filled > 0] - 1] = True
            final = ends & (gaps[np.arange(len(gaps)), filled][:, None] == 0)
            value += shared[1] * (y & ~joined).sum() + shared[3] * joined.sum() + shared[2] * (y & ~follows & ~final).sum()
            if gradient:
                np.add.at(slopes, words[words >= 0], (y - p)[words >= 0])
        return value, slopes

    steps = np.full(len(weights) + 4, 0.1)
    before = np.zeros(len(steps))
    for _ in range(rounds):
        _, slopes = likelihood(weights, shared, True)
        rest = []
        for i in range(4):
            e = np.zeros(4)
            e[i] = 1e-4
            rest.append((likelihood(weights, shared + e, False)[0] - likelihood(weights, shared - e, False)[0]) / 2e-4)
        now = np.concatenate([slopes, rest])
        steps = np.clip(np.where(now * before > 0, steps * 1.2, np.where(now * before < 0, steps * 0.5, steps)), 1e-4, 1.0)
        before = np.where(now * before < 0, 0.0, now)
        change = np.sign(before) * steps
        weights, shared = np.clip(weights + change[:-4], -12, 12), np.clip(shared + change[-4:], -12, 12)
    toxic = np.concatenate([t for t, _, _ in groups])
    tokens = np.concatenate([_passes(g, np.where(w >= 0, weights[w], np.nan), shared)[1].sum(axis=1) for _, g, w in groups])
    own = toxic.mean()
    weigh = np.where(toxic == 1, share / own, (1 - share) / (1 - own)) / len(toxic)
    x = np.stack([np.log1p(tokens), np.ones(len(tokens))], axis=1)
    curve = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ curve))
        slope = x.T @ (weigh * (toxic - p)) - np.array([1e-4, 0]) * curve
        bend = (x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-9])
        curve += np.clip(np.linalg.solve(bend, slope), -1, 1)
    return weights, shared, float(max(curve[0], 0.0)), float(curve[1])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, weights of the documents with it), summed for a while."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def hand_on() -> Iterator[pa.RecordBatch]:
        for toxic, counts in enumerate(held):
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()

    for batch in batches:
        for part in pieces(batch):
            for text, toxic, weight in zip(texts(part), part.column("toxic").to_pylist(), part.column("weight").to_pylist(), strict=True):
                held[int(toxic == 1)].update(dict.fromkeys(entries(_WORD.findall(folded(text)[0])), weight))
                if len(held[0]) + len(held[1]) > _HELD:
                    yield from hand_on()
    yield from hand_on()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            found = [minima(shingles(x, SHINGLE), MINIMA).view(np.int64) for x in texts(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "h", "minima"])


def _weighted(chosen: DataFrame) -> DataFrame:
    """(doc_id, toxic, weight) from (h, doc_id, toxic, minima): a unit over the number of
    documents that have the same min-hash, of the ``AGREE``-th most common one."""
    each = chosen.select("h", F.posexplode("minima").alias("k", "value"))
    shared = each.groupBy("k", "value").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = each.join(shared, ["k", "value"]).groupBy("h").agg(F.sort_array(F.collect_list("size"), False).alias("sizes"))  # at most MINIMA
    size = F.coalesce(F.try_element_at("sizes", F.lit(AGREE)), F.lit(1))
    return chosen.join(sizes, "h", "left").select("doc_id", "toxic", F.greatest(F.lit(1), F.round(_UNIT / size)).cast("long").alias("weight"))


def _general(counts: DataFrame, found: DataFrame, evident: float) -> list:
    """The entries ``found``, of beginnings only those with enough evidence beside their most common word's."""
    whole = counts.filter(~F.endswith("word", F.lit("*"))).select("word", "n1")
    begins = F.array(*(F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in PREFIXES))
    each = whole.select(F.explode(F.array_compact(begins)).alias("word"), F.col("n1").alias("top"))
    tops = each.join(found.filter(F.endswith("word", F.lit("*"))).select("word"), "word").groupBy("word").agg(F.max("top").alias("top"))
    out = []
    for r in found.join(tops, "word", "left").collect():
        if r.top is not None:
            n1, n0 = r.n1 - r.top, r.n - r.n1
            n = n1 + n0
            if n1 * (1 - evident) <= ODDS * evident * n0 or n1 <= 0 or n1 * math.log(n1 / n / evident) + (n0 * math.log(n0 / n / (1 - evident)) if n0 > 0 else 0) <= GENERAL:
                continue
        out.append(r)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from documents (doc_id, text) and labels (doc_id, toxic)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_sketches, "doc_id long, h long, minima array<long>")
    distinct = scratch.keep(labels.join(hashed, "doc_id").groupBy("h").agg(F.max_by("toxic", F.struct("toxic", "doc_id")).alias("toxic"), F.min("doc_id").alias("doc_id"), F.first("minima").alias("minima")), "distinct")
    chosen = scratch.keep(_weighted(distinct), "labels")
    scratch.drop(distinct)
    toxic_weight = F.sum(F.when(F.col("toxic") == 1, F.col("weight")).otherwise(0))
    n, n_toxic, weight, weight1 = chosen.agg(F.count("*"), F.count_if(F.col("toxic") == 1), F.sum("weight"), toxic_weight).first()
    out = Field()
    if n:
        out.level = float(np.log((n_toxic + 1e-9) / (n - n_toxic + 1e-9)))
    if not 0 < n_toxic < n:
        return out
    # Labels grow with the documents: the same join at every size, never a broadcast.
    read = scratch.keep(docs.join(chosen.hint("merge"), "doc_id").withColumn("order", F.xxhash64("doc_id")), "training")
    scratch.release()
    counts = read.select("text", "toxic", "weight").mapInArrow(_counts, "word string, toxic int, n long")
    units = lambda x: F.sum(x) / _UNIT
    counts = scratch.keep(counts.groupBy("word").agg(units(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), units(F.col("n")).alias("n")), "words")
    share, evident = n_toxic / n, weight1 / weight  # of the rows, and of families
    least = math.log(max(counts.count(), 1)) + 1
    n0 = F.col("n") - F.col("n1")
    gain = F.col("n1") * F.log(F.col("n1") / F.col("n") / evident) + F.when(n0 > 0, n0 * F.log(n0 / F.col("n") / (1 - evident))).otherwise(0)
    often = F.col("n1") * (1 - evident) > ODDS * evident * n0
    lexicon = _general(counts, counts.filter(often).withColumn("gain", gain).filter(F.col("gain") > least), evident)
    lexicon.sort(key=lambda r: (-r.gain, r.word.endswith("*"), -len(r.word), r.word))
    out.words = lexicon_numbers = {r.word: i for i, r in enumerate(lexicon)}
    start = np.array([math.log((r.n1 + 0.5) / (r.n - r.n1 + 0.5) / evident * (1 - evident)) for r in lexicon])
    schema = pa.schema([("toxic", pa.int32()), ("gaps", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(lexicon_numbers)
        for batch in batches:
            for part in pieces(batch):
                rows = [sequence(_WORD.findall(folded(x)[0]), numbers) for x in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array([g for g, _ in rows], schema.field(1).type), pa.array([w for _, w in rows], schema.field(2).type)], schema=schema)

    rows = []
    for toxic in (0, 1):
        some = read.filter((F.col("toxic") == 1) == bool(toxic)).select("order", "doc_id").orderBy("order", "doc_id").limit(SAMPLE // 2)
        sample = read.join(F.broadcast(some), ["order", "doc_id"])  # at most SAMPLE / 2 rows: bounded, so broadcast
        found = sample.select("text", "toxic").mapInArrow(sequences, "toxic int, gaps array<long>, words array<int>")
        rows += sorted((toxic, list(r.gaps), list(r.words)) for r in found.collect())
    out.weights, out.shared, out.slope, out.level = fit(rows, start, share)
    for table in (chosen, counts, read):
        scratch.drop(table)
    return out


def tag(text: str, model: Field) -> list[tuple[int, int, float]]:
    """(start, end, marginal) of the lexicon words that are toxic at 0.5 or more, in code points of the text; neighbours are joined to one span."""
    low, places = folded(text)
    matches = list(_WORD.finditer(low))
    gaps, hot = sequence([m[0] for m in matches], model.numbers)
    if not hot:
        return []
    at = [matches[i].span() for i in (np.cumsum(np.array(gaps[:-1]) + 1) - 1).tolist()]
    g, _, w = _padded([(gaps, hot)], model.weights)
    found: list[tuple[int, int, float]] = []
    for i, ((start, end), p) in enumerate(zip(at, _passes(g, w, model.shared)[1][0].tolist(), strict=True)):
        if p >= 0.5:
            if places:
                start, end = places[start], places[end - 1] + 1
            if found and i and gaps[i] == 0 and found[-1][1] <= start and not _WORD.search(low[at[i - 1][1] : at[i][0]]) and found[-1][1] == (places[at[i - 1][1] - 1] + 1 if places else at[i - 1][1]):
                found[-1] = (found[-1][0], end, max(found[-1][2], p))
            else:
                found.append((start, end, p))
    return found


def expected(rows: list[str], model: Field) -> np.ndarray:
    """The expected number of toxic lexicon words of each text."""
    out = np.zeros(len(rows))
    found: dict[int, list[tuple[int, list[int], list[int]]]] = {}
    for i, text in enumerate(rows):
        if model.words:
            gaps, hot = sequence(_WORD.findall(folded(text)[0]), model.numbers)
            if hot:
                found.setdefault(len(hot).bit_length(), []).append((i, gaps, hot))
    for group in found.values():
        for at in range(0, len(group), 256):
            part = group[at : at + 256]
            gaps, _, weights = _padded([(g, w) for _, g, w in part], model.weights)
            out[[i for i, _, _ in part]] = _passes(gaps, weights, model.shared)[1].sum(axis=1)
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(_SPAN))])
SCORES = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>"


def _scored(part: pa.RecordBatch, model: Field) -> tuple[pa.Array, pa.Array, pa.Array]:
    rows = texts(part)
    tokens = expected(rows, model)
    score = model.score(tokens)
    spans = [[dict(zip(("start", "end", "marginal"), x, strict=True)) for x in tag(t, model)] if e > 0 else [] for t, e in zip(rows, tokens, strict=True)]
    return pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.list_(_SPAN))


def scores(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, score, predicted, spans) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *_scored(part, model)], schema=_SCORES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, model: Field) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                score = model.score(expected(texts(part), model))
                yield part.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Whether labels of this id are kept from training."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def train_held_out(docs: DataFrame, labels: DataFrame) -> Field:
    return train(docs.filter(~held_out()), labels.filter(~held_out()))
