from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tintero.llm import fields
from tintero.llm.confusables import EXCEPTIONS, is_confusable, normalize, prototypes, spelling

CHANGED = [
    ("\uff23\uff41\uff50í\uff54\uff55\uff4c\uff4f \uff11", "Capítulo 1"),
    ("C\u200cap. 1", "Cap. 1"),
    ("Aqu\u00adel", "Aquel"),
    ("El\u2007río\u00a0y\u3000la", "El río y la"),
    ("104 \u2011 Aquel", "104 - Aquel"),
    ("cami\u0301no de\u0301bil nin\u0303o", "camíno débil niño"),
    ("Capіtulo", "Capitulo"),
    ("еѕрејо de la noche", "espejo de la noche"),
    ("\u2164ɑ\u217c\u217ce", "Valle"),
    ("\ufb01nal", "final"),
    ("\U0001d672\U0001d68a\U0001d699. 3", "Cap. 3"),
    ("Vοl.1", "Vol.1"),
    ("qսe v\u2170ene", "que viene"),
]
OTHER_SCRIPTS = [
    ("Пpивет, мир", "Привет, мир"), ("Мoсква", "Москва"), ("ꓮlice dijo", "Alice dijo"), ("\U000102a0lice dijo", "Alice dijo"), ("ƒuego y ɩuna", "fuego y iuna"), ("Сар. 108", "Cap. 108"), ("blanco е negro", "blanco e negro"), ("Capítulo З", "Capítulo 3"),
    ("Cаpítulo и песня", "Capítulo и песня"), ("Ψυxὴ", "Ψυχὴ"), ("Víctоr", "Víctor"), ("Ι\u0301caro y Ιcaro", "Ícaro y Icaro"),
]


@pytest.mark.parametrize(("text", "plain"), OTHER_SCRIPTS)
def test_the_consistent_script_is_chosen(text, plain):
    assert normalize(text) == plain


@pytest.mark.parametrize("text", ["Он со мной", "он сон", "В саду е", "гора и рога", "灯台とカ", "Łódź, Nguyễn, ș", "한국어漢字"])
def test_whole_script_words_stay_in_their_passage(text):
    assert normalize(text) == text


def test_far_words_of_a_passage_decide_as_near_ones():
    assert normalize("дом " + "со " * 50 + "сад") == "дом " + "со " * 50 + "сад"
    assert normalize("casa " + "со " * 50 + "fin") == "casa " + "co " * 50 + "fin"


def test_the_table_is_unicode_s():
    assert len(prototypes()) > 5000 and prototypes()["а"] == "a"
    assert (spelling("p", "Cyrillic"), spelling("P", "Greek"), spelling("é", "Cyrillic"), spelling("ж", "Latin")) == ("р", "Ρ", "е\u0301", None)


KEPT = [
    "Capítulo 1: Ωmega", "灯台", "—Спасибо, друг —dijo", "Ψυχὴ ἀθάνατος", "\u300c潮の地図\u300d", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\u2764\ufe0f", "1\ufe0f\u20e3", "3.ª 38 º \u00bd \u221a2 \u00d7 \u20ac", "tomo \u2163", "в саду, о мире", "«hola»\u2026 \u201ca\u201d \u2013 —",
    "Straße, Âme, Ève, irmã", "m\u00b2 y x\u00b3", "\u2116 5 \u2122 \u2103", "می\u200cخواهم", "日本\u3000語", "", "solo ascii",
]


@pytest.mark.parametrize(("text", "plain"), CHANGED)
def test_respelt(text, plain):
    assert normalize(text) == plain and is_confusable(text) and not is_confusable(plain)


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert normalize(text) == text and not is_confusable(text)


def test_null():
    assert normalize(None) is None and not is_confusable(None)


@given(st.text(alphabet="abcñáé 1-" + "аеорсухіѕјһАВЕКМНОРСТΑΒΕΖ" + "".join(EXCEPTIONS) + "\u00ad\u200b\u00a0\u0301\uff21\u2011", max_size=30))
def test_settles_and_stays_composed(text):
    once = normalize(text)
    assert normalize(once) == once
    if all(c in "abcñáé 1-" for c in text):
        assert once == text and unicodedata.normalize("NFC", once) == once


def test_operator(spark, odd_rows):
    found = fields.confusable_fields(odd_rows, "chapter_id", ["title", "content_html"])
    assert found.columns == ["id", "field"] and found.count() == 0
    more = spark.createDataFrame([(1, "C\u200cap", "x"), (1, "C\u200cap", "x"), (2, "CapÃ\u00adtulo\u200b", "a\nb\u00a0c")], "chapter_id long, title string, content_html string")
    assert sorted(tuple(r) for r in fields.confusable_fields(more, "chapter_id", ["title", "content_html"]).collect()) == [(1, "title"), (1, "title"), (2, "content_html")]
    assert fields.confusable_fields(more.limit(0), "chapter_id", ["title"]).count() == 0
    out = {tuple(r) for r in fields.normalized(more, "chapter_id", ["title", "content_html"]).collect()}
    assert out == {(1, "Cap", "x"), (2, "Capítulo", "a\nb c")}
    kept = fields.normalized(odd_rows, "chapter_id", ["title"]).collect()
    assert len(kept) == 7 and sum(r.title is None for r in kept) == 1
