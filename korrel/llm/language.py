"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary.
A word's probability is the sum over all of its segmentations into pieces, found
by the forward algorithm; a text's log-probability is the sum over its words.
Pieces are learned by expectation: each training word is segmented in all ways
under the current probabilities (equal ones at first), and the posterior piece
counts, from a forward-backward pass, are summed per language. Words are counted
where they are read and segmented once each, wherever they occur. What reaches the
driver is at most pieces x languages numbers.

Words are runs of letters, with the marks that follow them, in lower case and with
the vocabulary's word mark before them, however long. A character that no piece
covers counts as the vocabulary's unknown piece. Passes run over many distinct words
at once; in long words they are rescaled on the way, so that no probability gets too
small for a number. Each worker remembers the words it has scored.

A text that is null or has no letter (Unicode's category L; number signs such as a
half or a Roman numeral sign are none) is ``und`` with score 0. With no training
row at all every text is ``und``. A tie goes to the language that sorts first.
Rows with a null ``lang`` do not train. Repeated rows are predicted each; extra
columns are not read. An empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import Scratch, pieces, texts

UNKNOWN = "und"
#: Distinct words held by a task before it hands counts on, and remembered by a scorer.
HELD = 200_000
REMEMBERED = 600_000
_SMOOTH = 0.1
_BYTES = 4 << 20
_MARK = "▁"
_BASE = 0x100000001B3
#: Marked words up to this long need no rescaling; longer ones are rescaled every so many places.
_PLAIN, _EVERY = 16, 8
#: Places of words that are segmented at once.
_PLACES = 1 << 17


_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_INNER = regex.compile(r"[\p{L}\p{M}]+")


def words(text: str) -> list[str]:
    """Runs of letters and marks, lower case."""
    return _WORD.findall(text.lower())


def _codes(group: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(group), width).astype(np.uint64)


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring characters of each row."""
    out = np.zeros((codes.shape[0], codes.shape[1] - size + 1), dtype=np.uint64)
    for i in range(size):
        out *= np.uint64(_BASE)
        out += codes[:, i : i + out.shape[1]] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)
    out ^= out >> np.uint64(31)
    return out


class Vocabulary:
    """The pieces of a public sentencepiece model that consist of letters."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.unknown = model.unk_id()
        by_size: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and _INNER.fullmatch(piece.removeprefix(_MARK) or "a") and piece == piece.lower():
                by_size[len(piece)].append((piece, i))
        self.keys, self.ids = {}, {}
        for size, found in by_size.items():
            keys = _hashes(_codes([p for p, _ in found], size), size)[:, 0]
            order = np.argsort(keys)
            self.keys[size], self.ids[size] = keys[order], np.array([i for _, i in found])[order]

    def matches(self, group: list[str], width: int) -> dict[int, np.ndarray]:
        """By piece length, the piece that starts at each place of each marked word, or -1."""
        codes = _codes([_MARK + w for w in group], width + 1)
        out = {}
        for size, keys in self.keys.items():
            if size <= width + 1:
                hashes = _hashes(codes, size)
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                found = np.where(keys[at] == hashes, self.ids[size][at], -1)
                if size == 1:
                    found = np.where(found < 0, self.unknown, found)
                if (found >= 0).any():
                    out[size] = found
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_width(found: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups = defaultdict(list)
    for w in found:
        groups[len(w)].append(w)
    for width, group in groups.items():
        step = max(1, _PLACES // (width + 1))
        for at in range(0, len(group), step):
            yield width, group[at : at + step]


class _Chances:
    """The probabilities of the pieces of each length at each place of marked words."""

    def __init__(self, matched: dict[int, np.ndarray], chances: np.ndarray, width: int):
        self.matched = {size: np.ascontiguousarray(m.T) for size, m in matched.items()}
        self.padded = np.vstack([chances, np.zeros((1, chances.shape[1]))])  # -1 is no piece
        self.rows, self.languages, self.end = len(next(iter(matched.values()))), chances.shape[1], width + 1
        self.held = {size: self.padded[m] for size, m in self.matched.items()} if width < _PLAIN else None

    def at(self, size: int, place: int) -> np.ndarray:
        return self.held[size][place] if self.held else self.padded[self.matched[size][place]]

    def sums(self, back: bool = False, last_only: bool = False) -> tuple[list, list]:
        """Per place, the summed probability of what ends there (``back``: of what
        starts there), and the logarithm by which it is to be shifted."""
        near: dict[int, np.ndarray] = {0: np.ones((self.rows, self.languages))}
        out, shifts, shift = [near[0]], [0.0], 0.0
        reach = max(self.matched)
        for step in range(1, self.end + 1):
            total = np.zeros((self.rows, self.languages))
            for size in self.matched:
                if size <= step:
                    total += near[step - size] * self.at(size, self.end - step if back else step - size)
            near[step] = total
            near.pop(step - reach, None)
            if self.end > _PLAIN and step % _EVERY == 0 and step < self.end:
                near = {k: x / total for k, x in near.items()}
                shift = shift + np.log(total)
            if not last_only or step == self.end:
                out.append(near[step])
                shifts.append(shift)
        return out, shifts


def log_probabilities(found: list[str], own: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """(words, languages): log of each word's probability over all segmentations."""
    out = np.zeros((len(found), chances.shape[1]))
    place = {w: i for i, w in enumerate(found)}
    for width, group in _by_width(found):
        ends, shifts = _Chances(own.matches(group, width), chances, width).sums(last_only=True)
        out[[place[w] for w in group]] = np.log(ends[-1]) + shifts[-1]
    return out


def expectations(counts: dict[str, np.ndarray], own: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """(pieces, languages): expected uses of each piece in words with given counts per language.

    ``chances`` with one column are the same for every language.
    """
    languages = len(next(iter(counts.values())))
    out = np.zeros((own.size, languages))
    for width, group in _by_width(list(counts)):
        matched = own.matches(group, width)
        chance = _Chances(matched, chances, width)
        ahead, ahead_shift = chance.sums()
        back, back_shift = chance.sums(back=True)
        whole = np.log(ahead[-1]) + ahead_shift[-1]
        number = np.array([counts[w] for w in group], dtype=float)
        plain = number / ahead[-1] if width < _PLAIN else None
        for size, m in matched.items():
            for at in range(width + 2 - size):
                some = np.flatnonzero(m[:, at] >= 0)
                if not len(some):
                    continue
                after = width + 1 - at - size
                share = (ahead[at] * chance.at(size, at) * back[after])[some]
                if plain is None:
                    share = share * np.exp(ahead_shift[at] + back_shift[after] - whole)[some] * number[some]
                else:
                    share = share * plain[some]
                for language in range(languages):
                    out[:, language] += np.bincount(m[some, at], weights=share[:, language], minlength=own.size)
    return out


@dataclass
class Model:
    path: str
    languages: list[str]
    chances: np.ndarray  # (pieces, languages)


def train(docs: DataFrame, path: str, rounds: int = 1) -> Model:
    """A model from columns ``text`` and ``lang``; the documents are read once, their words segmented in each round."""
    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    own = vocabulary(path)
    if not languages:
        return Model(path, [], np.zeros((own.size, 0)))
    chances = np.full((own.size, 1), 1.0 / own.size)
    number = {x: i for i, x in enumerate(languages)}
    counted = pa.schema([("word", pa.string()), ("language", pa.int32()), ("n", pa.int64())])
    schema = pa.schema([("language", pa.int32()), ("piece", pa.int32()), ("uses", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in languages]

        def hand_on() -> Iterator[pa.RecordBatch]:
            for language, counts in enumerate(held):
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([language] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=counted)
                counts.clear()

        for batch in batches:
            for part in pieces(batch, limit=_BYTES):
                for text, lang in zip(texts(part), part.column("lang").to_pylist(), strict=True):
                    held[number[lang]].update(words(text))
                if sum(map(len, held)) > HELD:
                    yield from hand_on()
        yield from hand_on()

    def segment(batches: Iterator[pa.RecordBatch], chances: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        total = np.zeros((own.size, len(languages)))
        for batch in batches:
            table: dict[str, np.ndarray] = {}
            for word, language, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table.setdefault(word, np.zeros(len(languages)))[language] += n
            if table:
                total += expectations(table, own, chances)
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, language])], schema=schema)

    scratch = Scratch(docs.sparkSession) if rounds > 1 else None
    counts = rows.mapInArrow(count, "word string, language int, n long").groupBy("word", "language").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "words") if scratch else counts
    for _ in range(rounds):
        found = counts.mapInArrow(functools.partial(segment, chances=chances), "language int, piece int, uses double").groupBy("language", "piece").agg(F.sum(F.round("uses", 6).cast("decimal(38,6)")).cast("double").alias("uses"))
        uses = np.full((own.size, len(languages)), _SMOOTH)
        for batch in found.toArrow().to_batches():  # at most pieces x languages rows
            np.add.at(uses, (batch.column("piece").to_numpy(), batch.column("language").to_numpy()), batch.column("uses").to_numpy())
        chances = uses / uses.sum(axis=0)
    return Model(path, languages, chances)


class Scorer:
    """Predicts texts, remembering the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.own = vocabulary(model.path)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def _learn(self, new: list[str]) -> None:
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, self.logs = {}, np.zeros((0, len(self.model.languages)))
        logs = log_probabilities(new, self.own, self.model.chances)
        if len(self.rows) + len(new) > len(self.logs):
            grown = np.zeros((max(2 * len(self.logs), len(self.rows) + len(new)), logs.shape[1]))
            grown[: len(self.logs)] = self.logs
            self.logs = grown
        self.logs[len(self.rows) : len(self.rows) + len(new)] = logs
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))

    def predict(self, rows: list[str]) -> tuple[list[str], np.ndarray]:
        found = [words(x) for x in rows]
        predicted, score = [UNKNOWN] * len(rows), np.zeros(len(rows))
        some = [i for i, w in enumerate(found) if w]
        if not some or not self.model.languages:
            return predicted, score
        distinct = set(itertools.chain.from_iterable(found))
        if new := sorted(distinct - self.rows.keys()):
            if len(self.rows) + len(new) > REMEMBERED:
                new = sorted(distinct)
            self._learn(new)
        sizes = np.array([len(found[i]) for i in some])
        places = np.fromiter(map(self.rows.__getitem__, itertools.chain.from_iterable(found)), dtype=np.int64, count=int(sizes.sum()))
        sums = np.add.reduceat(self.logs[places], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        best = sums.argmax(axis=1)
        score[some] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b in zip(some, best.tolist(), strict=True):
            predicted[i] = self.model.languages[b]
        return predicted, score


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its share of the likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in pieces(batch, limit=_BYTES):
                predicted, score = scorer.predict(texts(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predicted), pa.array(score)], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language of at least this score, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in pieces(batch, limit=_BYTES):
                predicted, score = scorer.predict(texts(part))
                yield part.filter(pa.array((np.array(predicted) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Whether this id's row is kept from training."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2
