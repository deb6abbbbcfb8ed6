"""Byte-level BPE as a lazily determinised transducer, with streaming decode.

A text's encoding has one last token at every prefix, and a token may follow
another if and only if merging their joined bytes gives back that very pair. So
the encodings of all prefixes form a tree that can be grown byte by byte. A
transducer state is the part of the tree that is still open: the positions from
which some vocabulary entry could yet reach further, and the tokens on the ways
back to where those ways meet. What lies before that point can no longer change
and is emitted, at most one longest entry behind the input. States and moves are
made when first met and then looked up.

Decoding maps ids to bytes, some thousands at a time; ``Utf8``, a state machine, turns
bytes that arrive in any portions into complete code points. Texts are split into
pieces and decoded in portions too, so a very long text needs little more than itself.

Null texts count as empty: no ids. Special tokens are ordinary text. Rows may
repeat; extra columns are not read. A text of any length is
one stream. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import by_row

#: Pieces and states remembered by a worker; beyond that it starts anew.
REMEMBERED = 800_000
STATES = 250_000
#: Pieces encoded, and ids decoded, at a time.
PORTION = 1 << 16
PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a rank file or a ``tokenizers`` file of a byte-level model."""
    with open(path, "rb") as lines:
        if not path.endswith(".json"):
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        content = json.load(lines)
    # Such files show each byte as a printable character: itself, or the next one from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in content["added_tokens"]}
    return {bytes(map(byte.__getitem__, token)): i for token, i in content["model"]["vocab"].items() if token not in added}


def merge(data: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """Byte-pair merging by the definition: the least rank first, leftmost on a tie.

    It stops early when only ``least`` parts are left.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes single pieces of pre-split text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # A trie; entries from which others go on come first, so that a number tells.
        prefixes = {token[:i] for token in ranks for i in range(len(token))}
        number = {p: i for i, p in enumerate(sorted(prefixes, key=lambda p: (len(p), p)))}
        self.inner = len(number)
        for token in ranks:
            number.setdefault(token, len(number))
        self.child = {number[p[:-1]] << 8 | p[-1]: i for p, i in number.items() if p}
        self.token_of = [ranks.get(p, -1) for p in number]
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self._forget()

    def _forget(self) -> None:
        # An entry of a state: (parent's place, token that ends here, trie node or -1 if no entry goes on from here).
        start = ((-1, -1, 0),)
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {0: ()}

    def _edge(self, token: int, last: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of a token while it is merged, each with
        the rank of the merge that ends it."""
        known = self.edges[last].get(token)
        if known is None:
            data, ends, known = self.tokens[token], 1 << 60, []
            while True:
                known.append((data, ends))
                if len(data) == 1:
                    break
                ends = self.ranks[data]
                data = merge(data, self.ranks, 2)[-1 if last else 0]
            self.edges[last][token] = known
        return known

    def _follows(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when their joined bytes are merged.

        Merges run in the order of ranks, so a merge over the border happens if its
        rank comes before those that end the two parts (the left one's on a tie).
        """
        known = self.pairs.get(a << 20 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            rank = self.ranks.get
            right = self._edge(b, False)
            known = not any(over < ends_x and over <= ends_y for x, ends_x in self._edge(a, True) for y, ends_y in right if (over := rank(x + y)) is not None)
            self.pairs[a << 20 | b] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before = self.states[state]
        last = len(before)
        entries, child, token_of, inner = [], self.child.get, self.token_of, self.inner
        found = None
        for place, (parent, token, node) in enumerate(before):
            if node >= 0:
                node = child(node << 8 | byte, -1)
                if node >= 0:
                    if found is None and (ended := token_of[node]) >= 0 and (token < 0 or self._follows(token, ended)):
                        found = (place, ended, 0)
                    if node >= inner:
                        node = -1
            entries.append((parent, token, node))
        entries.append(found)
        # From the newest back: what a live entry's way to the root goes through, and how often ways meet there.
        children = [0] * (last + 1)
        wanted = [False] * (last + 1)
        for place in range(last, 0, -1):
            parent, _, node = entries[place]
            if node >= 0 or wanted[place]:
                wanted[place] = wanted[parent] = True
                children[parent] += 1
        root, out = 0, []
        while entries[root][2] < 0 and children[root] == 1:
            for place in range(root + 1, last + 1):
                if wanted[place] and entries[place][0] == root:
                    break
            root = place
            out.append(entries[root][1])
        _, token, node = entries[root]
        places = {root: 0}
        key = [(-1, token if node >= 0 else -2, node)]
        for place in range(root + 1, last + 1):
            if wanted[place]:
                parent, token, node = entries[place]
                places[place] = len(key)
                key.append((places[parent], token, node))
        frozen = tuple(key)
        number = self.numbers.get(frozen)
        if number is None:
            number = self.numbers[frozen] = len(self.states)
            self.states.append(frozen)
        move = self.moves[state << 8 | byte] = number, tuple(out)
        return move

    def _end(self, state: int) -> tuple[int, ...]:
        entries = self.states[state]
        out, place = [], len(entries) - 1
        while place > 0:
            out.append(entries[place][1])
            place = entries[place][0]
        self.ends[state] = tuple(reversed(out))
        return self.ends[state]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self._forget()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte)
            state, ids = move if move is not None else self._move(state, byte)
            if ids:
                out += ids
        end = self.ends.get(state)
        out += end if end is not None else self._end(state)
        return out


class _Pieces(dict):
    """The ids of each piece, as little-endian unsigned 32-bit bytes."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.transducer.encode(piece.encode()), dtype="<u4").tobytes()
        if len(ids) < 256:
            self[piece] = ids
        return ids


class Codec:
    """Text to ids and back for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern)
        self.pieces = _Pieces(Transducer(ranks))
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.names = [str(i) for i in range(len(self.table))]

    def encode(self, text: str) -> np.ndarray:
        if len(text) < PORTION:
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split.findall(text))), dtype="<u4")
        parts = map(self.pieces.__getitem__, (m[0] for m in self.split.finditer(text)))
        return np.frombuffer(b"".join(iter(lambda: b"".join(itertools.islice(parts, PORTION)), b"")), dtype="<u4")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in portions, each as soon as its last byte has come."""
        machine, ids = Utf8(), iter(ids)
        while portion := list(itertools.islice(ids, PORTION)):
            if part := machine.feed(b"".join(map(self.table.__getitem__, portion))):
                yield part
        if part := machine.close():
            yield part

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of any ids, well-formed or not."""
        return b"".join(map(self.table.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


class Utf8:
    """Incremental UTF-8: accepts bytes in any portions, gives complete code points.

    A state is what the next byte may be and how many more follow; an ill-formed
    sequence gives U+FFFD for its longest well-formed part, as Python does.
    """

    #: First byte from, to; second byte from, to; bytes that follow. (Fixed values: well-formed UTF-8.)
    LEADS = (
        (0xC2, 0xDF, 0x80, 0xBF, 1),
        (0xE0, 0xE0, 0xA0, 0xBF, 2),
        (0xE1, 0xEC, 0x80, 0xBF, 2),
        (0xED, 0xED, 0x80, 0x9F, 2),
        (0xEE, 0xEF, 0x80, 0xBF, 2),
        (0xF0, 0xF0, 0x90, 0xBF, 3),
        (0xF1, 0xF3, 0x80, 0xBF, 3),
        (0xF4, 0xF4, 0x80, 0x8F, 3),
    )

    def __init__(self):
        self.held = b""
        self.low, self.high, self.left = 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        at, view = 0, memoryview(data)
        while at < len(data):
            if not self.left:  # between code points: the well-formed stretch from here at once
                try:
                    out.append(str(view[at:], "utf-8"))
                    break
                except UnicodeDecodeError as e:
                    out.append(str(view[at : at + e.start], "utf-8"))
                    at += e.start
            at = self._step(data, at, out)
        return "".join(out)

    def _step(self, data: bytes, at: int, out: list[str]) -> int:
        """One byte; the place to go on from."""
        byte = data[at]
        if self.left:
            if self.low <= byte <= self.high:
                self.held += bytes((byte,))
                self.left -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.left:
                    out.append(self.held.decode())
                    self.held = b""
                return at + 1
            out.append("�")
            self.held, self.left = b"", 0
            self.low, self.high = 0x80, 0xBF
            return at  # the byte starts anew
        for first, last, low, high, left in self.LEADS:
            if first <= byte <= last:
                self.held, self.low, self.high, self.left = bytes((byte,)), low, high, left
                return at + 1
        out.append("�" if byte >= 0x80 else chr(byte))
        return at + 1

    def close(self) -> str:
        """What a sequence cut off at the end gives."""
        cut, self.held, self.left = bool(self.held), b"", 0
        self.low, self.high = 0x80, 0xBF
        return "�" if cut else ""


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row: number of ids, digests of the ids and of the decoded bytes."""

    def row(text: str | None) -> tuple:
        own = codec(path, pattern)
        ids = own.encode(text or "").tolist()
        names, back, at, same = hashlib.sha256(), hashlib.sha256(), 0, True
        for start in range(0, len(ids), PORTION):
            names.update((" " if start else "").encode() + " ".join(map(own.names.__getitem__, ids[start : start + PORTION])).encode())
        for part in own.decode_stream(ids):
            back.update(part.encode())
            same = same and text.startswith(part, at)
            at += len(part)
        return len(ids), names.hexdigest(), back.hexdigest(), same and at == len(text or "")

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_row(_DIGEST, row), columns)


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each text as an array column."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_row(schema, lambda x: (codec(path, pattern).encode(x or "").tolist(),)), "doc_id long, ids array<int>")
