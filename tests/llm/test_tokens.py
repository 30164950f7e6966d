from __future__ import annotations

import os

import pytest

from tintero.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{T.FOLDER}/byte_bpe_50k.tiktoken"), reason="no tokenizer files")
NAME = "byte_bpe_50k"
TEXTS = ["", "hola", "  dos  espacios \r\n\t x", "<|endoftext|> a", "日本語 русский \U0001f468\u200d\U0001f469 ñ", "a" * 5000, "don't 123abc!!", "\n\n\n", "x" + " " * 3000 + "y", "palabra " * 9000, "灯台の光、海へ。「そうだ」" * 400, "it's l'été!'s x''ll '!s «dónde»? e\u0301a\u0308b ¿qué?1a" * 30]


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_another_library_and_round_trip(other, text):
    ids = T.encode(text, NAME)
    assert ids == other.encode(text, add_special_tokens=False).ids
    assert T.decode(ids, NAME) == text


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("long", [2, 10, 100])
def test_pieces_add_up(text, long):
    parts = T.pieces(text, long)
    assert "".join(parts) == text
    assert [i for p in parts for i in T.encoding(NAME).encode_ordinary(p)] == T.encoding(NAME).encode_ordinary(text)


def test_operator(spark):
    df = spark.createDataFrame([(1, "hola mundo", [9]), (2, None, None), (3, "", None), (1, "hola mundo", [9]), (None, "x", None)], "doc_id long, text string, ids array<int>")
    out = sorted(((r.id, r.ids) for r in T.token_ids(df, "doc_id", "text", NAME).collect()), key=str)
    assert out == sorted([(1, T.encode("hola mundo", NAME))] * 2 + [(2, []), (3, []), (None, T.encode("x", NAME))], key=str)
    back = {(r.id, r.text) for r in T.decoded(T.token_ids(df, "doc_id", "text", NAME), "id", "ids", NAME).collect()}
    assert back == {(1, "hola mundo"), (2, ""), (3, ""), (None, "x")}
    assert T.token_ids(df.limit(0), "doc_id", "text", NAME).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k", "piece_bpe_32k", "byte_bpe_multi_50k"])
def test_other_vocabularies(name):
    assert T.encode("", name) == [] and len(T.encode("Hola, mundo: 日本語", name)) > 3


def test_long_texts_without_blanks_are_cut():
    text = "灯台の光、海へ。" * 10_000
    assert max(map(len, T.pieces(text))) <= T.LONG and "".join(T.pieces(text)) == text
