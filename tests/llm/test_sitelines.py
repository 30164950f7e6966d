from __future__ import annotations

import random

import pytest

from compare import compare
from tintero.llm import queries as Q
from tintero.llm.sitelines import exact_key, line_bands, repeated_lines, without_repeated_lines


def brute(rows, share=0.1, least=5):
    seen, total = {}, {}
    for i, site, text in rows:
        if text is None:
            continue
        total[site] = total.get(site, 0) + 1
        for key in {exact_key(x) for x in text.split("\n")} - {None}:
            seen[site, key] = seen.get((site, key), 0) + 1
    many = {k for k, n in seen.items() if n >= least and n >= share * total[k[0]]}
    return sorted((i, n) for i, site, text in rows if text is not None for n, x in enumerate(text.split("\n")) if (site, exact_key(x)) in many)


def corpus(seed, n=300):
    rng = random.Random(seed)
    notices = ["<p>Aviso legal: obra de aficionados {n}</p>", "<div>COMPARTE este   capítulo con Tus Amigos {n}</div>", "Traducci&oacute;n de Sendas Ligeras<br>", "<p>corta 12</p>", "Страница сайта, все права"]
    rows = []
    for k in range(n):
        site = rng.choice(["a", "a", "a", "b", None])
        lines = [f"<p>{rng.choice('abcdefgh')}{rng.random()} frase única del relato número {k}</p>" for _ in range(5)]
        for notice in notices:
            if rng.random() < 0.12:
                x = notice.replace("{n}", str(rng.randint(1, 9)))
                lines.insert(rng.randint(0, len(lines)), rng.choice([x, x.upper().replace("&OACUTE;", "&Oacute;"), x.replace(" ", "  ")]))
                if rng.random() < 0.2:
                    lines.append(x)
        rows.append((k, site, None if rng.random() < 0.05 else "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string").repartition(3)
    got = sorted(tuple(r) for r in repeated_lines(df, "chapter_id", "site", "content_html").collect())
    assert got == brute(rows) and got


def test_blanks_and_digits_of_every_kind_share_a_band():
    texts = ["Aviso legal de esta obra 12", "aviso\u3000legal\u1680de esta obra \uff11\uff12", "aviso&#x3000;legal de esta\u2028obra \u0663", "AVISO legal d\uff17e esta obra"]
    assert len({exact_key(x) for x in texts}) == 1
    assert len(set(line_bands(texts)[2][:, -1].tolist())) == 1


def test_small_batches_lose_nothing(spark):
    rows = corpus(4, 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string")
        got = sorted(tuple(r) for r in repeated_lines(df, "chapter_id", "site", "content_html").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


WORDS = "alba bruma cueva duna espada faro gruta hacha isla jarra lanza monte nieve olmo piedra roca sauce torre valle zarza".split()


def told(rng):
    return "<p>" + " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(8)) + "</p>"


def test_removal(spark):
    rng = random.Random(3)
    rows = [(i, site, None if text is None else "\n".join(told(rng) if "frase única" in x else x for x in text.split("\n"))) for i, site, text in corpus(3, 120)]
    df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string")
    drop = set(brute(rows))
    out = {r.id: r.text for r in without_repeated_lines(df, "chapter_id", "site", "content_html").collect()}
    for i, _, text in rows:
        assert out[i] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in drop))


def test_near_duplicates_are_removed_by_cluster(spark):
    rng = random.Random(5)
    names, months = ["Ana Ruiz", "Luis Gil", "Ivo Sanz"], ["marzo", "abril", "mayo"]
    rows = []
    for k in range(100):
        lines = [told(rng) for _ in range(4)]
        if k % 4 == 0:
            lines.append(f"<p>Traducción de {rng.choice(names)} el {k % 28 + 1} de {rng.choice(months)} de {2000 + k}</p>")
        if k % 5 == 0:
            lines.insert(0, "Este capítulo fue subido por el equipo de lectores de la casa, gracias" + rng.choice(["", " siempre", " hoy"]))
        if k < 5:
            lines.append("Este capítulo es de otro mundo, de lectores que no vuelven a la vieja casa")
        rows.append((k, "a" if k < 90 else None, "\n".join(lines)))
    df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string").repartition(3)
    assert repeated_lines(df, "chapter_id", "site", "content_html").count() < 40
    out = {r.id: r.text for r in without_repeated_lines(df, "chapter_id", "site", "content_html").collect()}
    for k, site, text in rows:
        kept = [x for x in text.split("\n") if site is None or not ("Traducción de" in x or "fue subido por" in x)]
        assert out[k] == "\n".join(kept) or site is None


def test_headings_and_short_remains_are_no_near_duplicates(spark):
    rng = random.Random(6)
    rows = [(k, "a", f"<h1>Capítulo {k}: {rng.choice(WORDS).title()} {rng.choice(WORDS).title()} {rng.choice(WORDS).title()}</h1>\n{told(rng)}") for k in range(60)]
    df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string")
    assert {r.id: r.text for r in without_repeated_lines(df, "chapter_id", "site", "content_html").collect()} == {k: t for k, _, t in rows}


def test_same_rows_as_sql(spark, data):
    compare(spark, "p5_found", data, Q.queries(), Q.oracle_sql())


def test_odd_rows(spark, odd_rows):
    assert repeated_lines(odd_rows, "chapter_id", "site", "content_html").count() == 0
    assert repeated_lines(odd_rows.limit(0), "chapter_id", "site", "content_html").count() == 0
    assert without_repeated_lines(odd_rows, "chapter_id", "site", "content_html").count() >= 7
