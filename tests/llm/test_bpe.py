import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from korrel.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    rng = random.Random(11)
    kinds = (lambda: rng.randint(32, 126), lambda: rng.randint(0x80, 0x24F), lambda: rng.randint(0x3040, 0x30FF), lambda: 0x1F600 + rng.randint(0, 60), lambda: rng.randint(97, 122))
    out = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    out += ["".join(rng.choice(["un", "aff", "ord", "able", "tion", "s", "'ll", " the", "ing"]) for _ in range(30)) for _ in range(300)]
    return [*out, "", "<|endoftext|> x", "a" * 20_001, "ab" * 3000, " " * 9000, "\n" * 4000 + "x", "0" * 5000, "x\x00y\r\n\t z"]


def test_ids_equal_the_library(codec, known, corpus):
    for text in [*odd_texts(), *(t for t in corpus if t)]:
        ids = codec.encode(text).tolist()
        assert ids == known.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_forgetting_changes_nothing(known, corpus):
    old = bpe.REMEMBERED, bpe.STATES, bpe.PAIRS
    bpe.REMEMBERED, bpe.STATES, bpe.PAIRS = 50, 40, 30
    try:
        small = bpe.Codec(PATH, public_tokenizers.PATTERN)
        for text in corpus:
            assert small.encode(text or "").tolist() == known.encode_ordinary(text or "")
    finally:
        bpe.REMEMBERED, bpe.STATES, bpe.PAIRS = old


def test_borders_as_merging_says(codec):
    rng, t = random.Random(2), codec.pieces.transducer
    common = [i for i in range(50_256) if t.tokens[i].isalpha() and len(t.tokens[i]) < 5]
    for _ in range(4000):
        a, b = rng.choice(common), rng.choice(common)
        x, y = t.tokens[a], t.tokens[b]
        assert t._follows(a, b) == (bpe.merge(x + y, t.ranks) == [x, y])


def test_output_comes_within_the_longest_entry(codec):
    t = codec.pieces.transducer
    longest = max(map(len, t.ranks))
    state, given = 0, 0
    for n, byte in enumerate(b"thequickbrownfoxunbelievablyjumps" * 20, 1):
        state, ids = t.moves.get(state << 8 | byte) or t._move(state, byte)
        given += sum(len(t.tokens[i]) for i in ids)
        assert n - given <= 2 * longest


@pytest.mark.parametrize("data", ["aé日😀".encode() * 3, b"\xff\xc3(\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80x", b"\xc0\xaf\xf4\x90\x80\x80", bytes(range(256)) * 2])
def test_utf8_in_any_portions(data):
    rng = random.Random(1)
    for _ in range(20):
        machine, out, at = bpe.Utf8(), "", 0
        while at < len(data):
            step = rng.randint(1, 4)
            out += machine.feed(data[at : at + step])
            at += step
        assert out + machine.close() == data.decode(errors="replace")


def test_stream_of_ids(codec):
    text = "naïve 😀 日本語 done"
    assert "".join(codec.decode_stream(codec.encode(text).tolist())) == text


def test_query_rows(spark, make_docs, corpus, known):
    docs = make_docs([*corpus, (0, "again"), (None, "no id")])
    rows = bpe.round_trip(docs.withColumn("n_tokens", docs.doc_id), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(corpus) + 2
    by = {(r.doc_id, r.decoded_sha256): r for r in rows}
    for i, text in [*enumerate(corpus), (0, "again"), (None, "no id")]:
        ids = known.encode_ordinary(text or "")
        r = by[i, hashlib.sha256((text or "").encode()).hexdigest()]
        assert r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(make_docs([]), PATH, public_tokenizers.PATTERN).collect() == []
    assert bpe.encode_column(make_docs(["a b"]), PATH, public_tokenizers.PATTERN).first().ids == known.encode_ordinary("a b")


def test_the_query_decodes_through_the_state_machine(spark, make_docs, monkeypatch):
    fed = []
    feed = bpe.Utf8.feed
    monkeypatch.setattr(bpe.Utf8, "feed", lambda self, data: fed.append(bytes(data)) or feed(self, data))
    monkeypatch.setattr(bpe, "PORTION", 3)
    own = bpe.codec(PATH, public_tokenizers.PATTERN)
    text = "x😜é" * 50 + "日本 語 " * 20
    ids = own.encode(text).tolist()
    assert "".join(own.decode_stream(ids)) == text and len(fed) > 10
    assert any(not x.isascii() and x.decode(errors="ignore").encode() != x for x in fed)  # portions end inside code points
    monkeypatch.undo()
    assert own.encode(text).tolist() == ids
