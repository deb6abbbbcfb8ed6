"""Sampled positions for exact fixed-length repeats.

A repeated string of ``span`` units (bytes or words) is found through one
sampled position: of the ``gram``-unit strings inside a window of ``span`` units
the one with the least hash is the window's *anchor* (the leftmost on a tie).
The choice depends on the window's content alone, so two equal windows have
equal anchors at equal offsets, wherever they stand.  Comparing windows anchor
by anchor therefore loses no repeat, while only about 2 / (span - gram + 2) of
the positions become rows.
"""

from __future__ import annotations

import numpy as np

#: Units hashed at once; longer documents go segment by segment, overlapping.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = np.uint64(24)
_POSITION_MASK = np.uint64((1 << 24) - 1)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive units, by one prefix sum."""
    n = len(units)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    powers, inverse = _tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((units + np.uint64(1)) * powers[:n], out=total[1:])
    out = total[size:] - total[:-size]
    out *= inverse[: n - size + 1]
    return mix(out)


def anchors(units: np.ndarray, span: int, gram: int):
    """(position, hash, first window, last window) of every anchor.

    ``first``..``last`` are the starts of the windows that chose it. Windows of a
    document longer than a segment may split one anchor into two rows.
    """
    parts = []
    width = span - gram + 1
    for at in range(0, max(len(units) - span + 1, 0), SEGMENT):
        part = units[at : at + SEGMENT + span - 1].astype(np.uint64)
        hashes = gram_hashes(part, gram)
        key = (hashes >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
        n = len(key)
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = key
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        chosen = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _POSITION_MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((first[1:] - 1, [windows - 1]))
        position = chosen[first]
        parts.append((position + at, hashes[position], first + at, last + at))
    if not parts:
        empty = np.empty(0, dtype=np.int64)
        return empty, np.empty(0, dtype=np.uint64), empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true flags."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
