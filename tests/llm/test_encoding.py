import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import encoding as e

pytestmark = pytest.mark.skipif(not os.path.exists(e.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    with open(e.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["Hello hello hello", "", None, "   ", "café naïve 🙂👩‍💻", "バッファは複雑すぎます。", "a" * 5000, "<|endoftext|> x", "it's they'll", "\r\n\t x  y\n\n", "1234567 89", "ไทย हिन्दी العربية"]


@pytest.mark.parametrize("words", [0, 3, 100_000])
def test_same_as_the_tokenizer(spark, plain, monkeypatch, words):
    monkeypatch.setattr(e, "LEXICON_WORDS", words)
    monkeypatch.setattr(e.compile_lexicon, "__defaults__", (words,))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int, word string")
    got = {r.doc_id: r.ids for r in e.encode(df.repartition(3)).collect()}
    assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in e.encode(df, only_lengths=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


def test_empty(spark):
    assert e.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_automaton(tmp_path_factory, words, others):
    path = str(tmp_path_factory.mktemp("a") / "x")
    with open(path, "wb") as f:
        e.save_automaton(e.build_automaton(list(words.items())), f)
    lex = e.Lexicon(path)
    ask = [*words, *others]
    starts, ids = lex.a["starts"], lex.a["ids"]
    for w, k in zip(ask, lex.numbers(ask).tolist(), strict=True):
        assert (k >= 0) == (w in words)
        if k >= 0:
            assert ids[starts[k] : starts[k + 1]].tolist() == words[w]


def test_suffixes_are_shared():
    a = e.build_automaton([(b"walking", [1]), (b"talking", [2])])
    assert len(a["final"]) == 8


def test_merging_is_exact(plain):
    m, rng = e.Merger(e.VOCABULARY), random.Random(3)
    for _ in range(500):
        w = bytes(rng.choice(b"abcde the\xc3\xa9\xe4\xb8") for _ in range(rng.randint(1, 200)))
        assert m._merged(w) == plain._encode_single_piece(w)
