from __future__ import annotations

import numpy as np

from tintero.llm import blocks
from tintero.llm.lines import containers, read

PAGE = """<nav><a href="/h1">Ranking</a> \u00b7 <a href="/d2">Foro</a> \u00b7 Contacto</nav>
<h1>Capítulo 50: Aquel espejo en la niebla</h1>
<p class="nota">Traducción: Gremio Lirio \u00b7 Corrección: Sombra Tercera</p>
<p>El archivero ciego abrazó la corona de espinas; después, nadie volvió a hablar de ello.</p>
<p>* * *</p>
<p>—No pienso volver a Ciudad Nyxoaz —respondió Quenraa sin levantar la vista.</p>
<p>Nota de la autora: el próximo arco ocurre en Kath; gracias por la paciencia.</p>

<section>
<span>70 comentarios en «El invierno contra Esrawen»</span>
<span>LunaMir: gracias por el capítulo</span>
</section>
<footer>\u00a9 2024 El Gremio Lector. Todos los textos se publican con fines de entretenimiento</footer>"""


def test_page_and_chapter():
    docs, nos = blocks.page_lines([PAGE])
    assert set(docs.tolist()) == {0} and nos.tolist() == [0, 2, 9, 10, 12]


def test_line_reader_agrees_with_plain_python():
    texts = ["<p>Él dijo: ¿3 años?</p>\n\n<br>\nÑandú &amp; co", "", "ÁRBOL — fin\n<div class='x'>"]
    x = read(texts)
    assert [(int(d), int(n)) for d, n in zip(x.doc, x.no, strict=True)] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (2, 1)]
    assert np.bincount(x.word_line, minlength=7).tolist() == [4, 0, 0, 3, 0, 2, 0]
    assert x.word_cap[x.word_line == 3].tolist() == [True, False, False]
    same = read(["él DIJO 9 AÑOS"])
    first = x.word_hash[x.word_line == 0]
    assert same.word_hash.tolist() == first.tolist()


def test_containers_hold_until_they_close():
    x = read(["<section>\n<p>a</p>\n</section>\n<p>b</p>"])
    path = containers(x)
    assert path[1] != 0 and path[3] == 0


def test_gradient():
    texts, labels = ["<p>uno dos</p>\n<a href='x'>tres</a>\n\nfin", "<p>x</p>"], np.array([0, 1, -1, 0, 1])
    net = blocks.Network({k: v.astype(np.float64) for k, v in blocks.Network.fresh(3).p.items()})
    batch = blocks.Batch(texts)
    _, g = net.step(batch, labels)
    for name in ("xf", "hb", "out", "tag", "bf"):
        flat = net.p[name].reshape(-1)
        k = int(np.abs(g[name]).reshape(-1).argmax())
        old, h = flat[k], 1e-2
        flat[k] = old + h
        up, _ = net.step(batch, labels)
        flat[k] = old - h
        down, _ = net.step(batch, labels)
        flat[k] = old
        assert abs((up - down) / (2 * h) - g[name].reshape(-1)[k]) < 2e-2 * max(0.05, abs(g[name].reshape(-1)[k]))


def test_operator(spark, odd_rows):
    df = spark.createDataFrame([(1, PAGE, "a"), (2, None, "b"), (3, "", "c"), (1, PAGE, "a")], "chapter_id long, content_html string, main string")
    found = sorted(tuple(r) for r in blocks.boilerplate_lines(df, "chapter_id", "content_html").collect())
    assert found == sorted([(1, n) for n in (0, 2, 9, 10, 12)] * 2)
    main = {r.id: r.main for r in blocks.main_content(df, "chapter_id", "content_html").collect()}
    assert main[2] is None and main[3] == "" and "Ranking" not in main[1] and "corona de espinas" in main[1]
    assert blocks.boilerplate_lines(df.limit(0), "chapter_id", "content_html").count() == 0
    assert blocks.main_content(odd_rows, "chapter_id", "content_html").count() == 7
    blocks.boilerplate_lines(odd_rows, "chapter_id", "content_html").collect()


def test_long_documents_in_parts(monkeypatch):
    texts = [PAGE * 40, PAGE, "x", PAGE + "\n" * 700]
    whole = [a.tolist() for a in blocks.page_lines(texts)]
    monkeypatch.setattr(blocks, "STEPS", 7)
    assert [a.tolist() for a in blocks.page_lines(texts)] == whole
