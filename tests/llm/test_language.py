from __future__ import annotations

import pytest

from tintero.llm import language as L

LINES = {
    "es": "Fue entonces cuando el archivero ciego recordó la canción de los muertos.",
    "pt": "Foi então que o rapaz sem nome guardou as cartas que nunca enviou.",
    "en": "Nobody in the village had ever seen the old blacksmith smile before dawn.",
    "ca": "Va ser llavors quan el missatger va recordar el quadern del seu pare.",
    "fr": "C'est alors que le vieux forgeron perdit les lettres jamais envoyées.",
    "it": "Fu allora che il vecchio fabbro riconobbe le lettere mai spedite.",
    "de": "Damals vergaß der alte Schmied die Briefe, die er niemals abgeschickt hatte.",
    "ru": "Ученик мага потерял масляную лампу, и больше никто об этом не говорил.",
    "ja": "そのとき老いた鍛冶屋は父の手帳を思い出し\u3001誰もそのことを二度と話さなかったのだった\u3002",
}


@pytest.mark.parametrize("lang", L.LANGUAGES)
def test_each_language(lang):
    _, _, found, confidence, _ = L.segments([LINES[lang]])
    assert [L.LANGUAGES[k] for k in found] == [lang] and confidence[0] > 0.9


def test_segments_of_a_mixed_text():
    text = "\n".join(["corta", LINES["es"], "***", LINES["es"], LINES["ru"], "", LINES["es"]])
    doc, no, lang, _, count = L.segments(["", text])
    assert (doc.tolist(), no.tolist(), [L.LANGUAGES[k] for k in lang], count.tolist()) == ([1, 1, 1], [1, 4, 6], ["es", "ru", "es"], [2, 1, 1])


def test_a_quotation_within_a_line_changes_nothing():
    line = LINES["es"] + " —Thank you, friend —" + " y la niebla cubrió el camino de la montaña."
    assert [L.LANGUAGES[k] for k in L.segments([line])[2]] == ["es"]


def test_held_out_accuracy(data):
    import pyarrow.parquet as pq

    names = {r["label"]: r["lang"] for r in pq.read_table(f"{data}/lang_labels.parquet").to_pylist()}
    docs = [r for r in pq.read_table(f"{data}/documents.parquet").to_pylist() if r["text"] and names.get(r["lang"])]
    doc, _, lang, _, _ = L.segments([r["text"] for r in docs])
    agree = sum(names[docs[d]["lang"]] == L.LANGUAGES[k] for d, k in zip(doc.tolist(), lang.tolist(), strict=True))
    assert agree / len(doc) > 0.6  # about a tenth of the labels is wrong, and mixed texts have segments in other languages


def test_operators(spark):
    rows = [(1, LINES["es"], "es", 0), (2, LINES["pt"], "es", 0), (3, LINES["en"], None, 0), (4, LINES["it"], "und", 0), (5, LINES["fr"], "??", 0), (6, None, "es", 0), (7, "", "es", 0), (8, "corta", "es", 0), (9, LINES["de"] * 2000, "deu", 0), (2, LINES["pt"], "es", 0), (10, "123 ***", "es", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, line_no int")
    labels = spark.createDataFrame([("es", "es"), ("deu", "de"), ("und", None), (None, "es")], "label string, lang string")
    found = sorted(tuple(r) for r in L.mislabelled_segments(df, labels, "doc_id", "text", "lang").collect())
    assert found == [(2, 0, "pt"), (2, 0, "pt"), (3, 0, "en"), (4, 0, "it"), (5, 0, "fr")]
    docs = {r.id: (r.lang, r.confidence) for r in L.document_languages(df, "doc_id", "text", "lang").collect()}
    assert docs[6] == (None, 0.0) and docs[7] == (None, 0.0) and docs[10] == (None, 0.0) and docs[9][0] == "de" and docs[8][0] is not None
    assert L.mislabelled_segments(df.limit(0), labels, "doc_id", "text", "lang").count() == 0
    assert L.document_segments(df, "doc_id", "text").columns == ["id", "line_no", "lang", "confidence", "lines", "label"]


def test_long_texts_are_summed_alike(monkeypatch):
    text = "\n".join(LINES.values()) * 3
    whole = L.line_scores([text, LINES["es"]])
    monkeypatch.setattr(L, "CHUNK", 37)
    parts = L.line_scores([text, LINES["es"]])
    for a, b in zip(whole, parts, strict=True):
        assert abs(a - b).max() < 1e-3


def test_letters_drawn_out_say_nothing():
    text = "Bajo la lluvia de otoño, el viejo herrero no quiso soltar la espada " + "a" * 3000
    assert [L.LANGUAGES[k] for k in L.segments([text, "The old smith would not let go of the sword that night " + "a" * 500])[2]] == ["es", "en"]
