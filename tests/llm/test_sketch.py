import hashlib
import random

import numpy as np
import pytest

from korrel.llm import sketch


def test_containment_is_estimated():
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    whole = sketch.sketch(" ".join(words))
    part = sketch.sketch(" ".join(words[:4000]))
    assert sketch.containment(part, whole) == 1.0
    assert abs(sketch.containment(whole, part) - 4000 / 60_000) < 0.01
    assert abs(len(whole) * sketch.SCALE / 60_000 - 1) < 0.05
    assert sketch.containment(sketch.sketch("a b c d e f"), whole) == 0.0


def test_merging_equals_sketching_all(corpus):
    rng = random.Random(1)
    for _ in range(50):
        hashes = [np.array([rng.randrange(1 << 48) for _ in range(rng.randint(1, 6))], dtype=np.uint64) for _ in range(3)]
        assert (sketch.merge(*map(sketch._scaled, hashes)) == sketch._scaled(np.concatenate(hashes))).all()


def test_text_form(corpus):
    for text in corpus:
        own = sketch.sketch(text)
        assert len(own) and (np.diff(own.astype(np.int64)) > 0).all()
        assert (sketch.read(sketch.show(own)) == own).all()
    assert sketch.show(sketch.sketch("A b c")) == sketch.show(sketch.sketch("a  B\tc"))


@pytest.mark.parametrize("parts", [1, 2, 5, 40, 200])
def test_rows(spark, make_docs, corpus, parts):
    texts = {i * 3: t or "" for i, t in enumerate(corpus)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = {r.doc_id: r for r in sketch.compare_with_next(make_docs([(i * 3, t) for i, t in enumerate(corpus)]).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows.keys() == texts.keys()
    order = sorted(texts, reverse=True)
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        text, half, r = texts[i], len(texts[i]) // 2, rows[i]
        new = text[: len(text) - half] + texts[following][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own = sketch.sketch(text)
        assert r.fingerprint == sketch.show(own) and r.edited_fingerprint == sketch.show(sketch.sketch(new))
        assert r.near_edited == sketch.containment(own, sketch.sketch(new))
        assert r.near_next == sketch.containment(own, sketch.sketch(texts[following]))


def test_empty_repeated_and_null(spark, make_docs):
    assert sketch.compare_with_next(make_docs([])).collect() == []
    assert sketch.compare_with_next(make_docs(["one two"])).first().near_next == 1.0
    rows = sketch.compare_with_next(make_docs([(1, "x y"), (1, "x y"), (None, "z"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 0), (0, 1), (1, 3), (1, 3)]
    assert sketch.sketches(make_docs(["x y", None])).count() == 2


def test_short_texts_in_long_ones():
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    whole = sketch.sketch(" ".join(words))
    for n in [5, 6, 8, 12, 20, 40, 100] * 20:
        at = rng.randrange(len(words) - n)
        part = words[at : at + n]
        assert sketch.containment(sketch.sketch(" ".join(part)), whole) == 1.0
        half = sketch.sketch(" ".join([*part, *(f"x{i}" for i in range(n))]))
        assert sketch.containment(half, whole) == pytest.approx((n - 4) / (2 * n - 4))


def shingle_sets(text):
    """The definition, without any hash: sets of five words."""
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_likeness_by_sets_of_words(spark, make_docs, corpus):
    texts = [t or "" for t in corpus]
    rows = sorted(sketch.compare_with_next(make_docs(texts).repartition(3)).collect(), key=lambda r: -r.doc_id)
    for i, r in enumerate(rows):
        text, following = texts[r.doc_id], texts[rows[(i + 1) % len(rows)].doc_id]
        half = len(text) // 2
        own, new, theirs = map(shingle_sets, (text, text[: len(text) - half] + following[:half], following))
        assert len(r.fingerprint) == 2 * sketch.WIDTH * len(own) and len(r.edited_fingerprint) == 2 * sketch.WIDTH * len(new)
        assert (r.near_edited, r.near_next) == (len(own & new) / len(own), len(own & theirs) / len(own))
        for other in rows[:5]:
            share = len(own & shingle_sets(texts[other.doc_id])) / len(own)
            assert sketch.containment(sketch.read(r.fingerprint), sketch.read(other.fingerprint)) == share


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_rows_without_an_id_are_spread(spark, make_docs, parts):
    import xxhash

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    texts = [(i if i % 3 == 0 else None, f"text {i} of some") for i in range(90)]
    try:
        found = sketch.compare_with_next(make_docs(texts).repartition(4))
        rows = found.collect()
        sizes = [n for n in found.rdd.glom().map(len).collect() if n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert max(sizes) < 90 / parts + 25
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1])))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest() for (_, t), (_, u) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in rows) == want


def test_long_texts_are_scaled():
    rng = random.Random(5)
    for n, parts in [(5004, 1), (5600, 2), (11_000, 4), (50_000, 8), (120_000, 8)]:
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
        every, own = sketch.shingles(text), sketch.sketch(text)
        assert len(every) == n - 4 and sketch.parts_of(own) == parts
        assert (own == every[every < (1 << 48) // parts]).all() and len(own) == pytest.approx(n / parts, rel=0.1)
        assert (sketch.read(sketch.show(own)) == own).all()


@pytest.mark.parametrize("whole", [256, 5000])
def test_merging_scaled_sketches(whole):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 48, 60_000, dtype=np.uint64)
    for _ in range(60):
        sets = [rng.choice(pool, int(10 ** rng.uniform(0, 4.7))) for _ in range(rng.integers(1, 5))]
        merged = sketch.merge(*(sketch._scaled(x, whole) for x in sets), whole=whole)
        assert np.array_equal(merged, sketch._scaled(np.concatenate(sets), whole))


def test_query_scales_and_finds_short_texts_in_long_ones(spark, tmp_path, make_docs):
    from korrel.llm.queries import op5_sketch

    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in [300, 700, 1500, 4000, 20_000]:
        long = words(n)
        for m in [2, 5, 6, 12, 30, 200]:
            at = rng.randrange(n - m)
            texts += [long, long[at : at + m]]  # by descending id, the short text comes first and the long one next
        texts += [long, long[: n // 2] + words(n // 4)]
    make_docs([" ".join(x) for x in texts]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(op5_sketch(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    kept = n_all = 0
    for r, words_ in zip(rows, texts, strict=True):
        text, following = " ".join(words_), " ".join(texts[r.doc_id - 1])
        own, new, theirs = map(shingle_sets, (text, text[: len(text) - len(text) // 2] + following[: len(text) // 2], following))
        held = len(r.fingerprint) // 12
        if len(own) <= 256:
            assert held == len(own) and (r.near_edited, r.near_next) == (len(own & new) / len(own), len(own & theirs) / len(own))
        else:
            assert len(own) / 8 * 0.8 < held < max(257, len(own) / 8 * 1.2) and held > 96
        for near, others in [(r.near_edited, new), (r.near_next, theirs)]:
            assert near == pytest.approx(len(own & others) / len(own), abs=0.2)
        if 5 <= len(words_) <= 200:
            assert r.near_next == 1.0
        kept, n_all = kept + held, n_all + len(own)
    assert kept < n_all / 4


def test_whole_is_checked(make_docs):
    with pytest.raises(ValueError):
        sketch.compare_with_next(make_docs(["a"]), whole=sketch.FEW)
