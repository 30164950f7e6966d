from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tintero.llm import fields
from tintero.llm.mojibake import _read, is_garbled, repair

TEXT = "Capítulo 3: Aún así, el señor salió después; —¿Quién te enseñó esa técnica? «El corazón de la montaña», pensó. Último año."
SHORT = "Capítulo 12: El corazón sin dueño"


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("times", [1, 2])
def test_utf8_read_otherwise_comes_back(read, times):
    for text in (TEXT, SHORT):
        bad = text
        for _ in range(times):
            bad = _read(bad.encode(), read)
        assert is_garbled(bad), bad
        assert repair(bad) == text


def test_utf8_read_as_gbk():
    bad = SHORT.encode().decode("gbk")
    assert is_garbled(bad) and repair(bad) == SHORT


@pytest.mark.parametrize("read", ["cp1251", "cp850"])
def test_one_byte_pairs(read):
    bad = SHORT.encode("cp1252").decode(read)
    assert is_garbled(bad) and repair(bad) == SHORT


def test_lost_letters():
    for lost in ("?", "\ufffd"):
        bad = "".join(lost if not c.isascii() else c for c in SHORT)
        assert is_garbled(bad) and repair(bad) == SHORT
    assert is_garbled("Nara\ufffd")


def test_escaped_after_garbling():
    bad = "Cap&Atilde;&shy;tulo 2"
    assert is_garbled(bad) and repair(bad) == "Capítulo 2"


def test_only_the_garbled_span_changes():
    mixed = "<p>Año nuevo — ¡sí!</p>\n<p>" + _read("la canción".encode(), "cp1252") + " y Ωmega</p>"
    assert repair(mixed) == "<p>Año nuevo — ¡sí!</p>\n<p>la canción y Ωmega</p>"


PLAIN = "Capítulo 3: Aún así, el señor salió después; la niña de la montaña habló con él"
READERS = "cp1252 latin-1 cp437 cp850 mac_roman cp1250 cp1251 cp1253 cp1257 iso8859_2 koi8_r gbk big5 euc_jp euc_kr shift_jis".split()
# A letter that became a dash or apostrophe at a word's end, or was swallowed, can't be told from a mark that is meant.
PARTLY = {("cp850", "shift_jis"), ("mac_roman", "cp1252"), ("mac_roman", "cp1250"), ("mac_roman", "cp1251")}


def pairs():
    for wrote in ("utf-8", "cp1252", "latin-1", "cp850", "mac_roman"):
        for read in READERS:
            try:
                bad = _read(PLAIN.encode(wrote), read)
            except UnicodeDecodeError:
                continue
            if bad != PLAIN:
                yield wrote, read, bad


@pytest.mark.parametrize(("wrote", "read", "bad"), list(pairs()))
def test_every_pair_in_one_paragraph_leaves_the_others(wrote, read, bad):
    around = ['<p title="é">La señal ± 5 y la fracción ¾ de taza, «col·legi» Ý</p>', "<p>Ωmega y 灯台 — Señora Añá…</p>"]
    got = repair("\n".join([around[0], f"<p>{bad}</p>", around[1]])).split("\n")
    assert is_garbled(bad)
    assert [got[0], got[2]] == around
    assert (got[1] == f"<p>{PLAIN}</p>") == ((wrote, read) not in PARTLY), got[1]


@pytest.mark.parametrize("chain", [("cp1252", "mac_roman"), ("cp1252",) * 3, ("cp437", "cp850"), ("latin-1", "cp1252", "cp1252"), ("mac_roman", "cp850", "cp1252")])
def test_several_rounds(chain):
    bad = PLAIN
    for read in chain:
        bad = _read(bad.encode(), read)
    assert is_garbled(bad) and repair(bad) == PLAIN


def test_two_pairs_in_one_record():
    text = "La niña abrió la montaña y la señora salió después"
    bad = "<p>" + text.encode("cp850").decode("cp1252") + "</p>\n<p>" + text.encode("cp1252").decode("mac_roman") + "</p>\n<p>" + text.encode("cp1252").decode("cp850") + "</p>\n<p>" + _read(text.encode(), "cp1257") + "</p>"
    assert repair(bad) == "\n".join([f"<p>{text}</p>"] * 4)


def test_words_lost_that_no_story_of_the_tables_has():
    assert repair("<p>La ni?a vio un murci?lago, un avi?n y un le?n</p>") == "<p>La niña vio un murciélago, un avión y un león</p>"


def test_tags_and_references_elsewhere_stay():
    mixed = '<p class="capÝtulo">se±or y monta±a</p>\n<p>ma&ntilde;ana y Cap&Atilde;&shy;tulo</p>'
    assert repair(mixed) == '<p class="capÝtulo">señor y montaña</p>\n<p>ma&ntilde;ana y Capítulo</p>'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("La señal ±5|¾ de taza|<b>«Sí»</b>|¿Qué?|Straße|Спасибо|灯台|ª º · …|— No|50 %|&ntilde;|faro?piso=3".split("|")), min_size=1, max_size=6), st.sampled_from(list(pairs())))
def test_other_paragraphs_never_change(words, pair):
    line = "<p>" + " ".join(words) + "</p>"
    got = repair(f"{line}\n<p>{pair[2]}</p>\n{line}").split("\n")
    assert got[0] == got[2] == line


KEPT = [
    "IRM&Atilde; &Acirc;me", "¿Quién es, que no lo veo? ¿Y él? Que venga.",
    "IRMÃ", "A MANHÃ TODA, cantaba la irmã", "Ωmega", "灯台", "\u300c潮の地図\u300d", "—Die Straße ist groß —dijo", "Âme, escribió; Ève", "Спасибо, друг", "tecleó faro?piso=12 y esperó", "¿Qué hacer\u2026?", "38 º, 3.ª, \u00bd ración, \u221a2 veces, \u00d7, 50 %",
    "El duelo", "menor—. No", "Adaptaci&oacute;n", "¿De verdad crees que está vivo?", "col\u00b7legi", "", "<a href=\"/x?id=3&amp;y=é\">a</a>",
]


@pytest.mark.parametrize("text", KEPT)
def test_meant_text_is_kept(text):
    assert not is_garbled(text) and repair(text) == text


def test_null():
    assert repair(None) is None and not is_garbled(None)


def test_operator(spark, odd_rows):
    assert fields.garbled_fields(odd_rows, "chapter_id", ["title", "content_html"]).count() == 0
    rows = spark.createDataFrame([(1, "CapÃ\u00adtulo", None), (2, None, "<p>x</p>\n<p>se\u251c\u2592or</p>")], "chapter_id long, title string, content_html string")
    assert sorted(tuple(r) for r in fields.garbled_fields(rows, "chapter_id", ["title", "content_html"]).collect()) == [(1, "title"), (2, "content_html")]
    assert {tuple(r) for r in fields.repaired(rows, "chapter_id", ["title", "content_html"]).collect()} == {(1, "Capítulo", None), (2, None, "<p>x</p>\n<p>señor</p>")}
    assert fields.repaired(odd_rows, "chapter_id", ["title", "content_html"]).count() == 7


def test_a_garbled_dash_alone():
    assert is_garbled("<p>ùNo pienso volver a Villa Orra</p>") and repair("<p>ùNo pienso volver</p>") == "<p>—No pienso volver</p>"
    assert is_garbled("<p>íCorred, que viene la marea!</p>")
    assert not is_garbled("Aqu\u00adel r\u00adío y el A\u00adño")
    assert not is_garbled("30 \u00b0C y \u00bd Vía, ó Eso")


def test_long_words_take_linear_time():
    text = "日本語" * 50_000 + "Ý" + "あ" * 50_000 + "?" + "い" * 50_000
    assert not is_garbled("¿que? " * 50_000)
    for run in ("a" * 200_000, "ж" * 200_000, "&ntilde;" * 30_000, "é;" * 60_000):
        assert repair(f"<p>{run} CapÃ\u00adtulo {run}</p>") == f"<p>{run} Capítulo {run}</p>"
    assert not is_garbled(text) and repair("<" * 200_000 + "é") == "<" * 200_000 + "é"
