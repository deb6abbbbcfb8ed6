import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        rows = [x if isinstance(x, tuple) else (first + i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd and empty ones."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    out: list = [None, "", " \n\t ", "a", "a b", "A B c", "a b C", "日本語 のテキスト 😀 " * 9, "a" * 700, "ab " * 400, text(3000)]
    for _ in range(12):
        out += [text(rng.randint(1, 80)), f"{text(rng.randint(0, 30))} {passage} {text(rng.randint(0, 30))}"]
    base = text(200).split()
    out += [" ".join(base)] * 4
    for _ in range(25):
        near = list(base)
        near[rng.randrange(len(near))] = rng.choice(words)
        out.append(" ".join(near))
    out += [out[10], out[10][5:], out[10].upper()]
    rng.shuffle(out)
    return out
