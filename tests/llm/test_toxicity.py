import math
import random
from itertools import product

import numpy as np
import pytest

from korrel.llm import toxicity

LEXICON = ["idiot", "moron", "scum", "weiß"]


def labelled(n=700, seed=3):
    """Documents with labels: toxic ones have two lexicon words or more; a family of near copies of one toxic text is among them."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    out = []
    family = [rng.choice(words) + "x" for _ in range(80)]
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            if rng.random() < 0.3:
                text = list(family)
                text[rng.randrange(len(text))] = rng.choice(words)
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randint(0, len(text)), rng.choice(LEXICON).capitalize())
        out.append((" ".join(text), int(toxic)))
    return out, family


@pytest.fixture(scope="module")
def trained(spark, make_docs):
    rows, family = labelled()
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(rows)], "doc_id long, quality int, toxic int")
    return toxicity.train(make_docs([x for x, _ in rows]), labels), family


def slow_passes(gaps, hot, shared):
    """log Z and marginals by listing all paths of a short sequence."""
    other, enter, leave, stay = shared
    tokens, places = [], []
    for t, w in enumerate(hot):
        tokens += [other] * gaps[t]
        places.append(len(tokens))
        tokens.append(w)
    tokens += [other] * gaps[-1]
    move = [[0.0, enter], [leave, stay]]
    total, toxic = 0.0, [0.0] * len(hot)
    for path in product((0, 1), repeat=len(tokens)):
        before, score = 0, 0.0
        for state, weight in zip(path, tokens, strict=True):
            score += move[before][state] + weight * state
            before = state
        total += math.exp(score)
        for i, p in enumerate(places):
            toxic[i] += math.exp(score) * path[p]
    return math.log(total), [x / total for x in toxic]


def test_passes_equal_all_paths():
    rng = random.Random(1)
    found, hots = [], []
    for _ in range(25):
        m = rng.randint(0, 4)
        gaps = [rng.randint(0, 3) for _ in range(m + 1)]
        if sum(gaps) + m <= 11:
            found.append((gaps, list(range(m))))
            hots.append([rng.uniform(-3, 3) for _ in range(m)])
    for shared in ([-1.0, -0.5, 0.2, 0.8], [-4.0, 0.5, 0.0, -0.3]):
        gaps, words, _ = toxicity._padded(found, np.zeros(0))
        hot = np.full(words.shape, np.nan)
        for i, h in enumerate(hots):
            hot[i, : len(h)] = h
        z, p = toxicity._passes(gaps, hot, np.array(shared))
        for i, (g, _) in enumerate(found):
            want_z, want_p = slow_passes(g, hots[i], shared)
            assert z[i] == pytest.approx(want_z)
            assert p[i, : len(want_p)] == pytest.approx(want_p)


def test_the_lexicon_is_the_toxic_words(trained):
    model, family = trained
    assert set(model.words) == set(LEXICON)
    assert not set(family) & set(model.words)


def test_held_out_rows(spark, make_docs, trained):
    model, _ = trained
    rows, _ = labelled(300, seed=8)
    got = {r.doc_id: r for r in toxicity.scores(make_docs([x for x, _ in rows]), model).collect()}
    right = sum(got[i].predicted == t for i, (_, t) in enumerate(rows))
    assert right >= 0.98 * len(rows)
    for i, (text, _) in enumerate(rows):
        for s in got[i].spans:
            assert all(w.lower() in LEXICON for w in text[s.start : s.end].split())


def test_offsets_where_lower_case_is_longer(trained):
    model, _ = trained
    text = "İİ. Idiot SCUM, weiß İ moron"
    spans = toxicity.tag(text, model)
    assert [text[a:b] for a, b, _ in spans] == ["Idiot SCUM, weiß", "moron"]


def test_empty_null_and_one_sided(spark, make_docs, trained):
    model, _ = trained
    rows = toxicity.scores(make_docs([None, "", (5, "same"), (5, "same")]).withColumnRenamed("lang", "score"), model).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1 and rows[0].score < 0.5 and not any(r.predicted for r in rows)
    assert toxicity.scores(make_docs([]), model).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(make_docs(["x"]), toxicity.train(make_docs(["x"]), none)).first().score == pytest.approx(0, abs=1e-6)
    odd = spark.createDataFrame([(0, 0), (None, 1), (1, None), (0, 0)], "doc_id long, toxic int")
    assert toxicity.train(make_docs(["x", "y"]), odd).words == {}


def test_keep_clean_keeps_columns(spark, make_docs, trained):
    model, _ = trained
    docs = make_docs(["a clean text", "idiot moron scum you idiot", None])
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_a_hot_family_of_near_copies_removes_no_word(spark, make_docs):
    rng = random.Random(6)
    rows, _ = labelled()
    base = [rng.choice("klmnop") + rng.choice("qrstuv") + "z" * (i % 5) + rng.choice("abcdefgh") for i in range(90)]
    base[20], base[50], base[70] = "idiot", "scum", "moron"
    for _ in range(900):  # a family of toxic near copies larger than the rest
        copy = list(base)
        copy[rng.choice([i for i in range(90) if i not in (20, 50, 70)])] = rng.choice(["abc", "def", "cab", "fed"]) + rng.choice("abcdefghij")
        rows.append((" ".join(copy), 1))
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs([x for x, _ in rows]), labels)
    assert set(model.words) == set(LEXICON)
    assert [s for s in toxicity.tag(rows[-1][0], model)]


def test_the_lexicon_has_no_most(spark, make_docs):
    rng = random.Random(1)
    words = ["".join(x) for x in product("bdfgklmnprst", "aeiou", "bdfgk", "aeiou", "xz")][:2600]
    rows = []
    for _ in range(16):  # each word in 16 toxic documents, among other words each time
        rng.shuffle(words)
        rows += [(" ".join(words[at : at + 40]), 1) for at in range(0, len(words), 40)]
    rows += [(" ".join(f"{rng.choice('cjq')}{rng.choice('aeiou')}{rng.choice('cjqv')}o" for _ in range(40)), 0) for _ in range(2 * len(rows))]
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs([x for x, _ in rows]), labels)
    assert {w for w in model.words if not w.endswith("*")} == set(words) and len(words) == 2600


def test_a_word_outside_the_sample_keeps_its_weight():
    weights, *_ = toxicity.fit([(1, [1, 1], [0]), (0, [3], [])] * 20, np.array([3.0, 4.0]), 0.3)
    assert weights[1] == 4.0


def test_unseen_forms_are_found_by_their_beginnings(spark):
    rng = random.Random(12)
    ends = ["ab", "bo", "cu", "de", "fi", "go"]
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    form = lambda: "zmoron" + "".join(rng.choice(ends) for _ in range(3))
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if toxic:
            text[5:5] = [form(), rng.choice(words), form()]
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.train_held_out(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "zmoron*" in model.words
    assert model.numbers["zmoronabab"] == model.numbers["zmoronxyz"] >= 0 and model.numbers["zmo"] == -1 == model.numbers["mild"]
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert [got[i].predicted for i, _, _ in labels] == [t for _, _, t in labels]
    text = rows[4][1]
    assert {text[s.start : s.end][:6] for s in got[4].spans} == {"zmoron"}
