"""A third of the rows copies of one text, a third near copies of another."""

import random

import pytest

from korrel.llm import simhash, substring_index, suffix
from test_simhash import slow_components, slow_fingerprint
from test_substring_index import slow as slow_words
from test_suffix import slow as slow_bytes


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    copied, base = " ".join(text(70)), text(90)
    out = [copied] * 300
    for _ in range(300):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(words)
        out.append(" ".join(near))
    out += [" ".join(text(rng.randint(1, 60))) for _ in range(300)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [2, 16])
def test_all_three(spark, make_docs, texts, parts):
    docs = make_docs(texts).repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        near = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: r.doc_id)
        byte = sorted(suffix.remove_repeats(docs).collect(), key=lambda r: r.row.doc_id)
        word = sorted(substring_index.remove_repeats(docs).collect(), key=lambda r: r.row.doc_id)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r.component_id for r in near] == slow_components([slow_fingerprint(t) for t in texts])
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in byte] == slow_bytes(list(enumerate(texts)), 100)
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in word] == slow_words(list(enumerate(texts)), 20)


def test_a_whole_task_of_one_anchor_is_streamed():
    """Rows of one rank in many batches give what one batch gives."""
    import pyarrow as pa

    rng = random.Random(4)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 16))) for _ in range(400)]
    table = pa.RecordBatch.from_arrays([pa.array([7] * 400, pa.int64()), pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int32()), pa.array([5] * 400, pa.int32()), pa.array([0] * 400, pa.int32()), pa.array([0] * 400, pa.int32()), pa.array(contexts, pa.binary())], schema=suffix._ROWS)
    run = suffix._first_of_each(12, 3)
    rows = lambda batches: [tuple(r.values()) for b in run(batches) for r in b.to_pylist()]
    whole = rows(iter([table]))
    seen, want = set(), []
    for i, c in enumerate(contexts):
        again = [o for o in range(len(c) - 11) if c[o : o + 12] in seen or seen.add(c[o : o + 12])]
        if again:
            want.append((i, 0, again[0], again[-1] + 12))
    assert whole == want
    for size in (1, 7, 150):
        assert rows(table.slice(a, min(size, 400 - a)) for a in range(0, 400, size)) == want
