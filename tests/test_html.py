from __future__ import annotations

import pytest

from tintero.functions.html_tree import parse
from tintero.operators.extract import extract_page


def texts(html, selector):
    return [e.text() for e in parse(html).select(selector)]


def test_implied_ends_and_void_elements():
    assert texts("<p>uno<p>dos<br>tres<div><p>x</div>y", "p") == ["uno", "dos tres", "x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "ul > li") == ["a", "b c", "c", "d"]
    assert texts("<b>sin fin<p>z", "p") == ["z"]


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ("div", 2), (".a", 1), ("#i", 1), ("[href*='/capitulo/']", 1), ('[data-x="1"]', 1), ("h1[class*='title']", 1), ("h3.text-center", 1), ("div > p", 1), ("div p", 2), ("p, h1", 3), ("div.a.b", 1), ("a[href]", 1),
    ],
)
def test_selectors(selector, found):
    html = "<h1 class='entry-title x'>t</h1><h3 class='text-center'>c</h3><div class='a b' id='i'><p>1</p><div data-x=1><span><p>2</p></span></div></div><a href='/capitulo/3'>l</a>"
    assert len(parse(html).select(selector)) == found


def test_groups_come_in_document_order():
    assert [e.tag for e in parse("<p>1</p><h1>2</h1><p>3</p>").select("h1, p")] == ["p", "h1", "p"]


def test_unreadable_selector():
    with pytest.raises(ValueError):
        parse("<p>").select("p:::")


def test_script_is_raw_and_invisible():
    e = parse('<article><script>var a="</p>";</script>x&nbsp;&amp;\u00ad y</article>').first("article")
    assert e.text() == "x & y"


def test_title_and_noise_leave_the_content():
    html = "<html><head><title>T</title></head><body><div class='entry-content'><h1>Capítulo 1: A</h1><script>x</script><p class='publi'>p</p><p>cuerpo&nbsp;b</p></div></body></html>"
    assert extract_page(html, None, None) == ("Capítulo 1: A", "<p>cuerpo&#160;b</p>", None)
    nested = "<article><div><h2>Capítulo 2</h2></div><p>x</p></article>"
    assert extract_page(nested, "article", None) == ("Capítulo 2", "<p>x</p>", None)


def test_selector_of_the_site_comes_first():
    html = "<div class='a'>uno</div><article>dos</article><h1>x</h1>"
    assert extract_page(html, "div.a", "h1")[1] == "uno"
    assert extract_page(html, "div.none", "h1")[1] == "dos"
    assert extract_page(html, "p:::", "h1")[1] == "dos"


def test_rejects():
    assert extract_page(None, None, None) == (None, None, "no html")
    assert extract_page("<p>x</p><title>t</title>", None, None) == (None, None, "no content")
    assert extract_page("<article>x</article>", None, None) == (None, None, "no title")


def test_deep_and_long_pages_do_not_fail():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert parse(deep).text() == "x" and parse(deep).inner_html() == deep
    assert len(parse("<article>" + "<p>" + "a" * 1_000_000 + "</p></article>").text()) == 1_000_000


def test_comments_and_quotes():
    html = "<p>a<!-- nota --><!--[if IE]><b>x</b><![endif]-->b</p>"
    assert parse(html).inner_html() == html and parse(html).text() == "ab" and not parse(html).select("b")
    assert parse("<a title='1 > 0' href=x>t</a>").first("a").attrs == {"title": "1 > 0", "href": "x"}
    assert parse('<p class="a>t</p>').text() == "t" and parse("a < b <c").text() == "a < b <c"
    assert parse("<SCRIPT>if (a<b) {}</SCRIPT ><p>x").text() == "x"
    assert parse("<p a=1 a=2 data-x>").first("p").attrs == {"a": "1", "data-x": ""}


def test_unclosed_marks_take_linear_time():
    for html in ("<a " * 200_000, '<a "' * 200_000, "<!--" * 200_000, "<a <a " * 100_000 + ">", "<" * 300_000 + ">"):
        parse(html)


def test_one_walk_finds_what_the_first_selector_finds():
    root = parse("<div><b>1</b><h3>2</h3><p><strong>3</strong></p><h1>4</h1></div>")
    assert [root.first_of(s)[1].text() for s in (("h1", "b"), ("h2", "p > strong", "h1"), ("i", "h3"))] == ["4", "3", "2"]
    assert root.first_of(("i",)) is None and root.first_of(("b", "h3"), lambda e: e.text() == "2")[0] == 1
    assert parse("<div><p>a <i>b</i></p></div>").first_with_text("a b").tag == "#root"
