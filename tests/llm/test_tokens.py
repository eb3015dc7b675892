import random

import pytest

from factlattice.llm import tokens

ODD = [
    "", None, " ", "a", "  two  spaces ", "tabs\t\tand\r\nbreaks\n\n", "don't WE'LL l'été", "<|endoftext|>", "x" * 3000, "-" * 5000, " " * 4000 + "x",
    "١٢٣½Ⅷ", "🔧🔧🔧́", "中文字符と仮名", "a\x1cb\x1f\x85c", "᠎﻿ x", "ab​cd", "\x00", "0123456789" * 300, "Ünïcödé Ñandú ß",
]


@pytest.fixture(scope="module")
def tok():
    return tokens.Tokenizer(tokens.read_vocabulary())


@pytest.fixture(scope="module")
def reference():
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_against_the_public_library(tok, reference):
    rng = random.Random(1)
    alphabet = "abcdeéß中 \n\t\x85 0123.,'st-_/ABИя"
    texts = [t for t in ODD if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    assert [tok.encode(t) for t in texts] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_backtracking_equals_plain_merges_on_any_bytes(tok):
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"abcnotheringsd \xc3\xa9\xe4\xb8") for _ in range(rng.randrange(1, 40)))
        assert tok.backtrack(data) == tok.merge(data)


def test_round_trip_and_defined_empty_results(spark):
    df = spark.createDataFrame([(i, t, "clash", [0]) for i, t in enumerate(ODD)], "doc_id bigint, text string, _text string, ids array<int>")
    enc = tokens.encode_texts(df)
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(ODD)
    back = {r.doc_id: r.text for r in tokens.decode_ids(enc).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_texts(df.where("doc_id < 0")).count() == 0
