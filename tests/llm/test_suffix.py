import hashlib
import random

import numpy as np
import pytest

from korrel.llm import suffix, windows


def slow(texts, span):
    """Per (id, text) in order: (n, removed, spans, digest), by a dictionary of all windows."""
    seen, out = set(), []
    for _, text in sorted(texts, key=lambda x: x[0]):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for i in range(len(data) - span + 1):
            window = data[i : i + span]
            if window in seen:
                cover[i : i + span] = b"\1" * span
            seen.add(window)
        rest = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(data), sum(cover), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("span,gram", [(100, 50), (20, 8), (7, 3)])
def test_every_window_has_its_anchor(span, gram):
    rng = random.Random(span)
    for n in (0, span - 1, span, span + 1, 900):
        for letters in (1, 2, 200):
            units = np.array([rng.randrange(letters) for _ in range(n)], dtype=np.uint64)
            pos, hashes, first, last = windows.anchors(units, span, gram)
            windows_of = [w for a, b in zip(first, last, strict=True) for w in range(a, b + 1)]
            assert windows_of == list(range(max(0, n - span + 1)))
            assert all(a <= b and b <= p <= a + span - gram for p, a, b in zip(pos, first, last, strict=True)) or letters < 200
            assert all(b <= p + 0 or p >= b for p, b in zip(pos, last, strict=True))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    units = np.array([rng.randrange(2) for _ in range(4000)] * 2, dtype=np.uint64)
    pos, hashes, first, last = windows.anchors(units, 12, 5)
    by = {}
    for p, h, a, b in zip(pos.tolist(), hashes.tolist(), first.tolist(), last.tolist(), strict=True):
        for w in range(a, b + 1):
            assert by.setdefault(units[w : w + 12].tobytes(), (p - w, h)) == (p - w, h)


def test_segments_change_nothing():
    rng = np.random.default_rng(5)
    units = rng.integers(0, 4, 5000).astype(np.uint64)
    whole = windows.anchors(units, 30, 9)
    windows.SEGMENT, old = 700, windows.SEGMENT
    try:
        parts = windows.anchors(units, 30, 9)
    finally:
        windows.SEGMENT = old
    spread = lambda x: {w: (p, h) for p, h, a, b in zip(*(y.tolist() for y in x), strict=True) for w in range(a, b + 1)}
    assert spread(whole) == spread(parts)


def test_doubling_names_equal_strings():
    rng = np.random.default_rng(2)
    units = rng.integers(0, 2, 3000).astype(np.uint64)
    for size, span in ((1, 8), (3, 10), (5, 5), (4, 11)):
        names = suffix.doubled(units, size, span)
        assert len(names) == 3000 - span + 1
        strings = {}
        for i, name in enumerate(names.tolist()):
            assert strings.setdefault(units[i : i + span].tobytes(), name) == name
        assert len(set(strings.values())) == len(strings)


@pytest.mark.parametrize("span", [100, 30])
def test_rows_equal_all_windows_compared(spark, make_docs, corpus, span):
    texts = list(enumerate([*corpus, "x" * 99, "x" * 100, "x" * 101, "é" * 400, "tail " * 30]))
    docs = make_docs(texts).repartition(7)
    got = sorted(suffix.remove_repeats(docs, span).collect(), key=lambda r: r.row.doc_id)
    want = slow(texts, span)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want


def test_empty_repeated_and_null(spark, make_docs):
    assert suffix.remove_repeats(make_docs([])).collect() == []
    a, b = "ab cd " * 40, "xy zw " * 40
    rows = suffix.remove_repeats(make_docs([(1, a), (1, a), (1, b), (2, b), (None, a), (None, None)]).withColumnRenamed("lang", "did"), 100, True).collect()
    got = sorted((r.row.doc_id or 99, r.n_bytes, r.n_removed) for r in rows)
    own = 240 - 6  # the text repeats itself after its first period
    assert [x[:2] for x in got] == [(1, 240), (1, 240), (1, 240), (2, 240), (99, 0), (99, 240)]
    assert [x[2] for x in got[:3]] == [own] * 3 and got[3][2] == 240 and got[5][2] == 240
