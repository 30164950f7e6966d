from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tintero.functions import text_rules as R


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


CASES = [
    ("Vol.2 Cap.10", "x", 2, "text"),
    ("RW 391", "x", 391, "text"),
    ("Ch. 7", "x", 7, "text"),
    ("Episodio Final", "https://s/2020/capitulo-12-a", 12, "url"),
    ("Capítulo 0", "/x/5", 5, "url"),
    ("Capítulo 99999999999", "/x/5", None, None),
    ("sin", "nada", None, None),
    (None, None, None, None),
    ("", "/y/9", 9, "url"),
]


@pytest.mark.parametrize(("text", "url", "number", "source"), CASES)
def test_chapter_number(spark, text, url, number, source):
    n, s = R.chapter_number("text", "url")
    row = spark.createDataFrame([(text, url)], "text string, url string").select(n, s).first()
    assert tuple(row) == (number, source)


TITLES = [
    ("Capítulo 3: Nombre 3", "Capítulo 3: Nombre 3"),
    ("CAPITULO 4 Nombre", "Capítulo 4: Nombre"),
    ("CAPÍTULO 2: Nombre", None),
    ("5 - Nombre", "Capítulo 5: Nombre"),
    ("6 Nombre", "Capítulo 6: Nombre"),
    ("Capítulo 12", "Capítulo 12: (Título no encontrado)"),
    ("Prólogo", None),
    ("Vol 1 Capítulo 3 Capítulo 4: Z", "Capítulo 4: Z"),
    ("Capítulo 12 - Nombre", "Capítulo 12: - Nombre"),
    ("Capítulo 1: L\ufffdola", "Capítulo 1: L\u2019ola"),
    (None, None),
    ("", None),
]


@pytest.mark.parametrize(("old", "new"), TITLES)
def test_standard_title(spark, old, new):
    assert values(spark, R.standard_title("t"), [(old,)], "t string") == [new]


HEADINGS = [("Capítulo 4", False), ("Capítulo 12", True), ("CAPÍTULO 2: B", False), ("CAPITULO 3 C", True), (None, False), ("", False)]


@pytest.mark.parametrize(("text", "valid"), HEADINGS)
def test_valid_heading(spark, text, valid):
    assert values(spark, R.valid_heading("t"), [(text,)], "t string") == [valid]


MARKUP = [
    ('<?xml version="1.0"?><p>a</p>', [], '<?xml version="1.0"?><p>a</p>'),
    ("<p>a&nbsp;b</p>", ["nbsp", "xml_declaration"], R.XML_DECLARATION + "\n<p>a&#160;b</p>"),
    ("<?xml?><hr/>", ["hr"], "<?xml?>"),
    ("<?xml?><href>", ["hr"], "<?xml?>"),
    ('<?xml?><img src="a"/ >', ["img"], '<?xml?><img src="a"/ />'),
    ("<?xml?><br></br>", [], "<?xml?><br></br>"),
    ('<?xml?><br class="x">', [], '<?xml?><br class="x">'),
    ("<?xml?>un markdown", ["markdown"], "<?xml?>un markdown"),
    ("<?xml?><MARKDOWN>x</MARKDOWN>", [], "<?xml?><MARKDOWN>x</MARKDOWN>"),
    ("<?xml?><MARKDOWN><br>", ["br"], "<?xml?><br />"),
    ('<?xml?><link href="a">', ["link"], '<?xml?><link href="a" />'),
    ('<?xml?><link href="a"/>', [], '<?xml?><link href="a"/>'),
    ("  <?xml?>", [], "  <?xml?>"),
    ("", ["xml_declaration"], R.XML_DECLARATION + "\n"),
    (None, None, None),
]


@pytest.mark.parametrize(("content", "codes", "fixed"), MARKUP)
def test_markup(spark, content, codes, fixed):
    df = spark.createDataFrame([(content,)], "c string").select(R.markup_issues("c"), R.repair_markup("c"))
    assert tuple(df.first()) == (codes, fixed)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>/brhimglnk \"'a?xm&;spdow", max_size=40), min_size=1, max_size=20))
def test_repair_settles(spark, texts):
    """A repaired file doesn't change when it is repaired again, but for the image rule, which may add one slash."""
    df = spark.createDataFrame([(t,) for t in texts], "c string").where(~F.col("c").rlike("(?i)<img"))
    once = df.select(R.repair_markup("c").alias("c"))
    twice = once.select("c", R.repair_markup("c").alias("d"))
    assert twice.where("c <> d AND NOT c RLIKE '(?i)<(link|hr|br|markdown|img)'").count() == 0


def test_small_rules(spark):
    row = spark.createDataFrame([("a & <b>", "uno dos.xhtml", " x , y,")], "a string, b string, c string").select(
        R.html_escape("a"), R.url_quote("b"), R.subjects_of("c"), R.or_default(F.lit(" "), "d"), R.media_type(F.lit("c.PNG")), R.stem(F.lit("X.EPUB")), R.chapter_file(F.lit(12345)), R.download_seconds(F.lit(500), F.lit(5))
    ).first()
    assert tuple(row) == ("a &amp; &lt;b&gt;", "uno%20dos.xhtml", ["x", "y", ""], "d", "image/png", "X", "Capitulo12345.xhtml", 220.0)


def test_stylesheet_link(spark):
    rows = [("<head></head>",), ('<head><link rel="stylesheet" type="text/css" href="../Styles/stylesheet.css" /></head>',), ("nada",), (None,)]
    out = values(spark, R.link_stylesheet("c"), rows, "c string")
    assert out[0].count("<link") == 1 and out[1] == rows[1][0] and out[2] == "nada" and out[3] is None
