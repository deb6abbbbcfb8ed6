import hashlib
import re

import pytest

from korrel.llm import substring_index
from korrel.llm.common import Scratch


def slow(texts, span):
    seen, out = set(), []
    for _, text in sorted(texts, key=lambda x: x[0]):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        cover = [False] * len(words)
        for i in range(len(words) - span + 1):
            window = tuple(words[i : i + span])
            if window in seen:
                cover[i : i + span] = [True] * span
            seen.add(window)
        rest = " ".join(w for w, c in zip(words, cover, strict=True) if not c)
        out.append((len(words), sum(cover), hashlib.sha256(rest.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("span,gram,batches", [(20, 8, 3), (5, 2, 5), (20, 20, 1)])
def test_rows_equal_all_windows_compared(spark, make_docs, corpus, span, gram, batches):
    texts = list(enumerate([*corpus, "w " * 19, "w " * 20, "w " * 21, "a\tb\x0bc\x0cd\r\n" * 30, "x\x85y\xa0z " * 40]))
    got = sorted(substring_index.remove_repeats(make_docs(texts).repartition(5), span, gram, batches).collect(), key=lambda r: r.row.doc_id)
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == slow(texts, span)


def test_batches_as_they_come(spark, make_docs, corpus):
    """The index by itself, without knowing what follows, and with compaction."""
    texts = list(enumerate(corpus))
    scratch = Scratch(spark)
    index = substring_index.Index(scratch, 3)
    cover = {i: set() for i, _ in texts}
    for n, at in enumerate(range(0, len(texts), 12), 1):
        docs = make_docs(texts[at : at + 12]).selectExpr("doc_id as did", "0 as v", "coalesce(text, '') as text")
        for r in substring_index.add(index, docs, scratch).collect():
            cover[r.did].update(range(r.start, r.end))
        assert len(index.runs) == n.bit_count() and index.levels == [i for i in range(8, -1, -1) if n >> i & 1]
    assert [len(cover[i]) for i, _ in texts] == [x[1] for x in slow(texts, 20)]
    before = sum(spark.table(r).count() for r in index.runs)
    index.compact()
    assert len(index.runs) == 1 and spark.table(index.runs[0]).count() == before == spark.table(index.runs[0]).distinct().count()
    index.drop()


def test_runs_are_merged_and_joined_without_a_shuffle_of_theirs(spark, make_docs, corpus):
    scratch = Scratch(spark)
    index = substring_index.Index(scratch, 3)
    plans = []
    write, index.write = index.write, lambda rows, name: plans.append((name, rows._jdf.queryExecution().executedPlan().toString())) or write(rows, name)
    for at in (0, 20, 40):
        docs = make_docs(list(enumerate(corpus))[at : at + 20]).selectExpr("doc_id as did", "0 as v", "coalesce(text, '') as text")
        substring_index.add(index, docs, scratch)
    runs, batches = [p for n, p in plans if n == "run"], [p for n, p in plans if n == "batch"]
    assert len(runs) == 4 and not any("Exchange" in p for p in runs) and all(p.count("Exchange") == 1 for p in batches)
    index.drop()


def test_words_with_one_hash(spark, make_docs, corpus, monkeypatch):
    """Even if all words have the same hash, only equal windows match."""
    from korrel.llm import repeats

    texts = list(enumerate(corpus[:40]))
    docs = [(i, 0, t or "") for i, t in texts]
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(substring_index, "word_units", lambda found: np.array([len(w) % 2 for w in found], dtype=np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*docs, strict=True)], names=["did", "v", "text"])
    rows = [r for b in substring_index._windows(20, 8)(iter([batch])) for r in b.to_pylist()]
    cover = {i: set() for i, _ in texts}
    seen = set()
    for r in rows:
        key = (r["h"], r["check"])
        if r["check"] is None or key in seen:
            cover[r["did"]].update(range(r["start"], r["end"]))
        seen.add(key)
    assert len({r["h"] for r in rows}) < len({r["check"] for r in rows})
    assert [len(cover[i]) for i, _ in texts] == [x[1] for x in slow(texts, 20)]
    assert repeats.word_units([b"a", b"a", b"b"])[1:].tolist() != repeats.word_units([b"a", b"a", b"b"])[:2].tolist()


def test_empty_repeated_and_null(spark, make_docs):
    assert substring_index.remove_repeats(make_docs([])).collect() == []
    a = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(1, a), (1, a), (2, a + " more"), (None, a), (None, None), (3, "few words")]).withColumnRenamed("lang", "did").withColumnRenamed("source", "h")
    rows = substring_index.remove_repeats(docs, with_text=True).collect()
    got = sorted((99 if r.row.doc_id is None else r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in rows)
    assert got == [(1, 30, 0, a), (1, 30, 0, a), (2, 31, 30, "more"), (3, 2, 0, "few words"), (99, 0, 0, ""), (99, 30, 30, "")]


def test_all_ids_null(spark, make_docs):
    rng = __import__("random").Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [" ".join(rng.choice(words) for _ in range(25)) + f" {passage}" for _ in range(60)]
    rows = substring_index.remove_repeats(make_docs([(None, t) for t in texts] * 2).repartition(3)).collect()
    assert len(rows) == 120 and sorted(r.n_removed for r in rows)[:4] == [0, 0, 30, 30]
    from korrel.llm import repeats

    with repeats.corpus(make_docs([(None, t) for t in texts])) as own:
        assert own.texts.select("did").distinct().count() == 60  # no common bucket
        assert own.texts.filter(f"did < {1 << 62}").count() == 0


def test_ids_of_any_size(spark, make_docs):
    a = " ".join(f"w{i}" for i in range(30))
    ids = [-(1 << 63), -(1 << 63) + 1, -3, -2, -1, 0, 1, (1 << 63) - 3, (1 << 63) - 2, None]
    rows = substring_index.remove_repeats(make_docs([(i, f"{a} x{k}") for k, i in enumerate(ids)])).collect()
    got = {r.row.doc_id: r.n_removed for r in rows}
    assert got == {i: 0 if i == ids[0] else 30 for i in ids}
