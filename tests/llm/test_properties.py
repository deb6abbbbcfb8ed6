import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from korrel.llm import bpe, media, packing, repeats, sketch, windows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CODEC = bpe.Codec(PATH, public_tokenizers.PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
QUICK = settings(max_examples=150, deadline=None)


@QUICK
@given(st.text(max_size=80))
def test_codec(text):
    ids = CODEC.encode(text).tolist()
    assert ids == KNOWN.encode_ordinary(text) and CODEC.decode(ids).decode() == text


@QUICK
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine(data, step):
    machine = bpe.Utf8()
    parts = [machine.feed(data[i : i + step]) for i in range(0, len(data), step)]
    assert "".join(parts) + machine.close() == data.decode(errors="replace")


@QUICK
@given(st.binary(max_size=2000))
def test_media(data):
    payload = media.padded(data)
    stored = media.store(payload)
    assert media.load(stored)[0] == payload
    assert len(media.parse(b"\xff\xfa" + data[:300] + stored).offsets) >= len(payload) // media.UNIT


@QUICK
@given(st.binary(max_size=600))
def test_parsing_any_bytes_ends(data):
    audio = media.parse(data)
    assert audio.skipped <= len(data) and all(a + s <= len(data) for a, s in zip(audio.offsets, audio.sizes, strict=True))


@QUICK
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(2, 12), st.data())
def test_anchors(values, span, data):
    gram = data.draw(st.integers(1, span))
    units = np.array(values, dtype=np.uint64)
    found = {}
    covered = []
    for p, h, a, b in zip(*(x.tolist() for x in windows.anchors(units, span, gram)), strict=True):
        assert a <= b <= p and p + gram <= a + span
        covered += range(a, b + 1)
        for w in range(a, b + 1):
            assert found.setdefault(tuple(values[w : w + span]), (p - w, h)) == (p - w, h)
    assert covered == list(range(max(0, len(values) - span + 1)))


@QUICK
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=20))
def test_merged(spans):
    starts = np.array([a for a, _ in spans], dtype=np.int64)
    ends = np.array([a + n for a, n in spans], dtype=np.int64)
    a, b = repeats.merged(starts, ends)
    assert sorted({i for x, n in spans for i in range(x, x + n)}) == [i for x, y in zip(a, b, strict=True) for i in range(x, y)]
    assert (a[1:] > b[:-1]).all()


@QUICK
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), min_size=1, max_size=6))
def test_seen(batches):
    seen, known = repeats.Seen(), set()
    for i, values in enumerate(batches):
        if values:
            got = seen.repeats(np.array(values, dtype=np.uint64), 2 * i, 2 * i + 1)
            for v, again in zip(values, got.tolist(), strict=True):
                assert again == (v in known)
                known.add(v)


@QUICK
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 50), max_size=20))
def test_plans(histogram):
    bins = packing.plan(histogram, 30)
    assert all(0 < sum(items) <= 30 and n > 0 for items, n in bins)
    got = {}
    for items, n in bins:
        for x in items:
            got[x] = got.get(x, 0) + n
    assert got == {k: n for k, n in histogram.items() if n}
    places = packing.Places(bins)
    taken = {}
    for length, n in histogram.items():
        if n:
            where = places.find(np.full(n, length), np.arange(n))
            for b, o in zip(*(x.tolist() for x in where), strict=True):
                for i in range(o, o + length):
                    assert taken.setdefault((b, i), length) == length or False
    used = {}
    for b, i in taken:
        used.setdefault(b, set()).add(i)
    assert all(x == set(range(len(x))) for x in used.values())
    assert len(taken) == sum(k * n for k, n in histogram.items())


@QUICK
@given(st.text(alphabet="ab \n", max_size=200), st.text(alphabet="ab \n", max_size=200))
def test_sketches(a, b):
    x, y = sketch.sketch(a), sketch.sketch(b)
    assert 0 <= sketch.containment(x, y) <= 1 == sketch.containment(x, x)
    assert (sketch.merge(x, y) == sketch.merge(y, x)).all()
