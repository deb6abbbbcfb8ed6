import random

import pytest

import corpus_pipeline
from korrel.llm import near


def slow(texts):
    """The least index of each component by all pairs of shingle sets."""
    sets = []
    for t in texts:
        words = (t or "").split()
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if root(i) == i}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(800)]
    out = [None, "", " ", "a b", "a b c"]
    for _ in range(12):  # near copies on both sides of 0.8, chains among them
        base = [rng.choice(words) for _ in range(rng.randint(6, 250))]
        out.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [2, 16])
def test_all_pairs(spark, make_docs, texts, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = make_docs(texts).repartition(5)
        got = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == slow(texts)


def test_copies_that_differ_in_one_word_go(spark, make_docs):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    copies = [" ".join([*base[: k * 7], "ander", *base[k * 7 + 1 :]]) for k in range(30)]
    assert [r.doc_id for r in corpus_pipeline.distinct(spark, make_docs([" ".join(base), *copies]), "").collect()] == [0]


def test_rows_and_columns(spark):
    a, b = "one two three four five six", "other words that are not like them at all"
    rows = [(None, a), (None, a), (3, a), (3, a), (None, b), (None, b), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, node string, did int")
    got = near.keep_one(docs)
    assert got.schema == docs.schema
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect()) == [(-1, b), (3, a), (7, "")]
    assert near.keep_one(docs.limit(0)).collect() == []


def test_pairs_that_may_be_similar_are_found_in_any_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 200, dtype=np.uint8)
    rows, sketch = [], np.arange(120, dtype=np.uint32).tobytes()
    for key, size in [(1, 1), (2, 3), (3, 60), (4, 2), (5, 1)]:
        for _ in range(size):
            least = base.copy()
            least[rng.permutation(200)[: rng.integers(0, 90)]] += 1
            rows.append((key, len(rows), int(rng.integers(0, 40)), int(rng.integers(90, 120)), least.tobytes(), sketch))
    want = []
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            same = sum(p == q for p, q in zip(x[4], y[4], strict=True))
            if x[0] == y[0] and x[2] != y[2] and min(x[3], y[3]) + 1 >= 0.8 * max(x[3], y[3]) and same >= near.AGREE:
                want.append((x[1], y[1]))
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["key", "node", "root", "n", "bytes", "sketch"])
    assert len(want) > 20
    for size in (1, 2, 7, 100):
        got = [tuple(r.values()) for b in near._alike(table.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert sorted(got) == want


def test_a_large_family_below_the_threshold_makes_few_pairs(spark, make_docs, monkeypatch):
    """Copies that share bands, but are less similar than 0.8, are compared where they meet."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40)]
    texts = set()
    while len(texts) < 300:
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(40)] = "".join(rng.choice("abcdefg") for _ in range(6))
        texts.add(" ".join(copy))
    texts = [" ".join(base), *sorted(texts)]
    kept = []
    keep = near.Scratch.keep
    monkeypatch.setattr(near.Scratch, "keep", lambda self, df, name: kept.append((name, out := keep(self, df, name), out.count())) or out)
    got = {r.doc_id for r in near.keep_one(make_docs(texts)).collect()}
    assert got == slow(texts)
    assert sum(n for name, _, n in kept if name == "pairs") < 300 * 6


def test_sketches_lose_no_similar_pair():
    import numpy as np

    from korrel.llm.windows import mix

    rng = np.random.default_rng(8)
    passed = 0
    for size in (1, 4, 30, 500, 513, 700, 6000):
        for similar in (0.8, 0.6):
            mine = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            others = []
            for extra in (0, size // 10, size // 3):
                common = int(np.ceil(similar * (2 * size + extra) / (1 + similar)))
                others.append(np.concatenate([mine[: min(size, common)], rng.integers(0, 1 << 63, max(0, size + extra - common), dtype=np.uint64)]))
            exact = [near.similarity(np.sort(mine), np.sort(x)) >= near.SIMILAR for x in others]
            may = near._may(near.sketch(mine), [near.sketch(x) for x in others], size, np.array([len(x) for x in others]))
            assert all(m for m, e in zip(may, exact, strict=True) if e)
            if max(map(len, others)) <= near.SKETCH:
                assert may.tolist() == exact
            elif similar == 0.6 and size > near.SKETCH:
                assert not may.any()
            passed += sum(exact)
    assert passed >= 14
    assert len(near.sketch(mix(np.arange(5000, dtype=np.uint64)))) == near.SKETCH


@pytest.mark.parametrize("block", [1, 3])
def test_large_bands_are_dealt_by_pairs_of_blocks(spark, make_docs, texts, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "HOT", 1)
    assert {r.doc_id for r in near.keep_one(make_docs(texts)).collect()} == slow(texts)
