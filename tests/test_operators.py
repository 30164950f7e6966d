from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tintero.operators import audit as A
from tintero.operators import book as B
from tintero.operators import extract as X
from tintero.operators import normalize as N
from tintero.operators import select as S
from tintero.operators.sites import dispatch

CONFIG = "priority int, site string, url_token string, case_insensitive boolean, sel_content string, sel_title string, sel_index_container string, sel_list_item string, sel_link string, sel_number string, sel_next string"


def config(spark):
    return spark.createDataFrame(
        [
            (1, "Uno", "novela", True, "article", "h1", "ul", "ul li", "a", None, "a.next"),
            (2, "Dos", "novelas.net", True, "div.x", "h1", "ul", "li", "a", "span.n", None),
            (3, "Tres", "Torre", False, None, None, None, "a", "a", "a", None),
        ],
        CONFIG,
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_dispatch(spark):
    urls = spark.createDataFrame([("https://NOVELA.x",), ("https://novelas.net/1",), ("torre",), ("Torre",), (None,)], "url string")
    assert {(r.url, r.site) for r in dispatch(urls, config(spark)).collect()} == {("https://NOVELA.x", "Uno"), ("https://novelas.net/1", "Uno"), ("torre", None), ("Torre", "Tres"), (None, None)}
    longest = dispatch(urls, config(spark), longest_token_first=True)
    assert longest.where("url LIKE '%net%'").first().site == "Dos"
    assert dispatch(urls, config(spark), default_site="Dos").where("url IS NULL").first().site == "Dos"


def test_index_links_and_next(spark):
    html = "<ul><li><a href='/c-1'>Capítulo 1</a></li><li><a href='c-2'>Final</a></li><li>nada</li><li><a href='x'>sin</a></li></ul><a class='next' href='?p=2'>»</a>"
    pages = spark.createDataFrame([(1, "https://novela.x/i", html), (2, "https://novela.x/j", None)], "page_id long, url string, html string")
    links = X.numbered_links(X.index_entries(pages, config(spark)))
    assert rows(links, "pos", "chapter_no", "url", "source") == [(0, 1, "https://novela.x/c-1", "text"), (1, 2, "https://novela.x/c-2", "url")]
    assert rows(X.next_pages(pages, config(spark))) == [("https://novela.x/i", "https://novela.x/i?p=2")]


def test_last_wins_with_ties_nulls_and_repeats(spark):
    links = spark.createDataFrame([("i", 1, "a", 0, 5), ("i", 1, "b", 3, 5), ("i", 1, "b", 3, 5), ("i", 1, "c", 9, None), ("i", None, "d", 1, 9), ("j", 1, "e", 0, 0)], "index_url string, chapter_no int, url string, pos int, seen_at int")
    assert rows(X.last_wins(links, ["index_url", "chapter_no"], ["seen_at", "pos"])) == [("i", 1, "b"), ("j", 1, "e")]
    assert X.last_wins(links.limit(0), ["index_url"], ["pos"]).count() == 0


def test_closure_with_chain_self_link_and_cycle(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("s", "s"), ("x", "y"), ("y", "x"), (None, "q")], "url string, next_url string")
    starts = spark.createDataFrame([("a",), ("s",), ("x",), ("a",)], "url string")
    assert rows(X.closure(spark, starts, links)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("s", "s", 0), ("x", "x", 0), ("x", "y", 1)]
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(100)], "url string, next_url string")
    assert X.closure(spark, spark.createDataFrame([("0",)], "url string"), chain).count() == 101


def test_selection(spark):
    index = spark.createDataFrame([(n, f"u{n}") for n in (1, 2, 3, 5, 8)], "chapter_no int, url string")
    wanted = S.requested_numbers(spark.createDataFrame([("2, 5,9",), ("1, x",), ("",), (None,)], "request string"))
    assert [r[0] for r in rows(S.select_chapters(index, "list", wanted=wanted))] == [2, 5]
    assert rows(S.not_found(index, wanted)) == [(9,)]
    assert S.in_range(index, 5, 2).count() == 0
    assert S.up_to(index).count() == 5 and S.up_to(index, 3).count() == 3
    with pytest.raises(ValueError):
        S.select_chapters(index, "none")


def test_heading_plan_keeps_one_per_level(spark):
    files = spark.createDataFrame([(1, "<h1>Capítulo 10: A</h1><h1>Capítulo 11: B</h1><h2>Capítulo 12: C</h2><h3>x</h3><p>y</p>"), (2, "<h1>basura</h1>"), (3, None), (4, "")], "id int, content string")
    plan = N.heading_plan(X.headings(files, "id", "content"))
    assert rows(plan.where("keep"), "id", "level", "pos") == [("1", 1, 0), ("1", 2, 2)]
    out = {r.id: r for r in N.apply_headings(files, plan, "id", "content").collect()}
    assert out["1"].content == "<h1>Capítulo 10: A</h1><h2>Capítulo 12: C</h2><p>y</p>" and out["2"].content == "" and out["3"].content is None and not out["4"].changed


def test_titles_are_planned_and_applied(spark):
    files = spark.createDataFrame(
        [(1, "<html><head></head><body><p><strong>12 - Nombre</strong></p><p>x</p></body></html>"), (2, "<html><head><title>v</title></head><body><h2>Capítulo 13: B</h2></body></html>"), (3, "<h1>Prólogo</h1>"), (4, None)], "id int, content string"
    )
    changes = N.title_changes(N.title_places(files, "id", "content"))
    assert rows(changes, "id", "place", "new_title", "promote") == [("1", "p > strong", "Capítulo 12: Nombre", True), ("2", "h2", "Capítulo 13: B", True)]
    out = {r.id: r.content for r in N.apply_titles(files, changes, "id", "content").collect()}
    assert out["1"] == "<html><head><title>Capítulo 12: Nombre</title></head><body><h1>Capítulo 12: Nombre</h1><p>x</p></body></html>"
    assert "<title>Capítulo 13: B</title>" in out["2"] and "<h1>Capítulo 13: B</h1>" in out["2"] and out["3"] == "<h1>Prólogo</h1>" and out["4"] is None


def test_one_pass_gives_what_plan_and_apply_give(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    planned = N.apply_titles(pages, N.title_changes(N.title_places(pages, "page_id", "html")), "page_id", "html")
    assert rows(N.standardized(pages, "page_id", "html"), "id", "content", "changed") == rows(planned)
    files = spark.read.parquet(f"{data}/chapters.parquet").where("content_html IS NOT NULL")
    plan = N.heading_plan(X.headings(files, "chapter_id", "content_html"))
    assert rows(N.cleaned(files, "chapter_id", "content_html")) == rows(N.apply_headings(files, plan, "chapter_id", "content_html"))
    assert rows(N.heading_report(files, "chapter_id", "content_html"), "id", "pos", "is_valid", "keep") == rows(plan, "id", "pos", "is_valid", "keep")
    assert N.cleaned(files.limit(0), "chapter_id", "content_html").count() == 0


def test_rules_on_strings_are_those_on_columns(spark):
    from tintero.functions import text_rules as R

    texts = ["Capítulo 3: A", "CAPITULO 4", "capÍtulo 5: x", "12 - Uno", "12", " 7. B ", "x\ufffdy Capítulo 9 – Z", "Capítulo 10 A", "Capítulo 1", "Capítulo  2: á", "", "\u00a012 x", "Capítulo 3\nB", "3 <b>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [(r[0], r[1]) for r in df.select(R.standard_title("t"), R.valid_heading("t")).collect()] == [(R.standard_title_of(t), R.is_valid_heading(t)) for t in texts]


def test_audits(spark):
    files = spark.createDataFrame([(1, "Capítulo 12: A", "Capítulo 12: A "), (2, None, "x"), (3, "", ""), (4, "Capítulo 4", "otro")], "id int, h1 string, title string")
    assert [r[0] for r in rows(A.format_problems(files), "id")] == [2, 3, 4]
    assert [r[0] for r in rows(A.title_mismatches(files), "id")] == [2, 4]
    assert [r[0] for r in rows(A.title_mismatches(files, strict=False), "id")] == [4]


def test_gaps_and_found_make_the_range(spark):
    rng = random.Random(3)
    found = [(b, rng.randint(1, 40)) for b in "ab" for _ in range(15)] + [("c", None), ("d", 1), ("a", 0)]
    df = spark.createDataFrame(found, "book_id string, chapter_no int")
    gaps = {tuple(r) for r in A.missing_chapters(df).collect()}
    for b in "ab":
        have = {n for x, n in found if x == b and n}
        assert {n for x, n in gaps if x == b} | have == set(range(1, max(have) + 1)) and not {n for x, n in gaps if x == b} & have
    assert not [g for g in gaps if g[0] in "cd"]
    assert A.missing_chapters(df.limit(0)).count() == 0


def spine(spark, n, book="b"):
    return spark.createDataFrame([(book, k, f"Text/Capitulo{k + 1:04d}.xhtml") for k in range(n)], "book_id string, spine_idx int, href string")


@pytest.mark.parametrize(("n", "parts", "sizes"), [(10, 4, [3, 3, 3, 1]), (5, 4, [2, 2, 1]), (6, 6, [1] * 6), (7, 1, [7]), (3, 4, [])])
def test_parts(spark, n, parts, sizes):
    plan = B.split_in_parts(spine(spark, n), parts).orderBy("part").collect()
    assert [r.end_idx - r.start_idx + 1 for r in plan] == sizes
    assert all(r.total_parts == parts for r in plan)
    s = spine(spark, n)
    if sizes:
        assert B.sections_of_parts(s, B.split_in_parts(s, parts)).count() == n


def test_bad_split_sizes_are_refused(spark):
    for split in (B.split_in_parts, B.split_in_chunks):
        with pytest.raises(ValueError):
            split(spine(spark, 3), 0)
    assert B.split_range(spine(spark, 5), 2, 9).count() == 0 and B.split_range(spine(spark, 5), 3, 2).count() == 0
    assert rows(B.split_range(spine(spark, 5), 2, 5), "start_idx", "end_idx") == [(1, 4)]


def test_custom_split_is_the_fold(spark):
    rng = random.Random(5)
    for _ in range(4):
        chapters = sorted(rng.sample(range(1, 60), 25))
        ends = sorted(rng.sample(range(1, 70), 6))
        expected, last = [], 0
        for end in ends:
            part = [c for c in chapters if last < c <= end]
            if part:
                expected.append((part[0], part[-1]))
                last = part[-1]
        m = spark.createDataFrame([("b", c, k) for k, c in enumerate(chapters)], "book_id string, chapter_no int, spine_idx int")
        e = spark.createDataFrame([("b", x) for x in ends] + [("b", None)], "book_id string, end_no int")
        got = B.split_custom(m, e).orderBy("part").collect()
        assert [(r.first_chapter, r.last_chapter) for r in got] == expected
        assert [r.part for r in got] == list(range(1, len(expected) + 1))


def test_pages_are_inserted_in_order(spark):
    requests = spark.createDataFrame([("b", 1, "X", 2), ("b", 2, "Y", 2), ("b", 3, "Z", 4), ("b", 4, "W", 99)], "book_id string, req_ord int, name string, after_chapter int")
    got = [r.href for r in B.insert_pages(spine(spark, 5), requests).orderBy("new_idx").collect()]
    c = [f"Text/Capitulo{k:04d}.xhtml" for k in range(1, 6)]
    assert got == [c[0], c[1], "info_libro_1.xhtml", "info_libro_2.xhtml", c[2], c[3], "info_libro_3.xhtml", c[4]]


def test_contents_entries_after_their_sections(spark):
    toc = spark.createDataFrame([("b", None, 10 * k, f"t{k}", f"h{k}") for k in range(30)] + [("b", 1, 5, "under", "u"), ("c", None, 0, "t", "h")], "book_id string, parent_id int, pos int, title string, href string")
    pages = spark.createDataFrame([("b", 1, 9, "p1"), ("b", 2, 9, "p2"), ("b", 3, 24, "p3"), ("b", 4, 99, "p4"), ("none", 1, 0, "p")], "book_id string, k int, spine_idx int, href string")
    got = B.insert_toc_entries(toc, pages)
    h = [f"h{k}" for k in range(30)]
    assert [(r.pos, r.href) for r in got.where("book_id = 'b'").orderBy("pos").collect()] == list(enumerate(h[:10] + ["p1", "p2"] + h[10:25] + ["p3"] + h[25:] + ["p4"]))
    assert rows(got.where("book_id <> 'b'")) == [("c", 0, "t", "h")]


def test_first_title_in_depth_first_order(spark):
    toc = spark.createDataFrame([("b", 1, None, 0, "A", "a"), ("b", 2, 1, 0, "B", "b"), ("b", 3, None, 1, "C", "b"), ("b", 4, 2, 0, "D", "d")], "book_id string, toc_id int, parent_id int, pos int, title string, href string")
    assert rows(B.toc_titles(spark, toc)) == [("b", "a", "A"), ("b", "b", "B"), ("b", "d", "D")]


def test_first_titles_beyond_the_limits_of_recursive_queries(spark):
    wide = spark.range(1_100_000).selectExpr("'w' AS book_id", "CAST(id AS INT) AS toc_id", "CAST(CASE WHEN id % 10 <> 0 THEN id - id % 10 END AS INT) AS parent_id", "CAST(id AS INT) AS pos", "'t' || id AS title", "'h' || id AS href")
    deep = spark.range(8).selectExpr("'d'", "CAST(id AS INT)", "CAST(CASE WHEN id > 0 THEN id - 1 END AS INT)", "0", "'t' || id", "'h' || id % 7")
    got = B.toc_titles(spark, wide.union(deep))
    assert rows(got.groupBy("book_id").count()) == [("d", 7), ("w", 1_100_000)]
    assert got.where("book_id = 'd' AND href = 'h0'").collect()[0].title == "t0"


def test_contents_in_a_circle_end(spark):
    toc = spark.createDataFrame([("b", 1, None, 0, "A", "a"), ("b", 2, 1, 0, "B", "b"), ("b", 1, 2, 0, "C", "c"), ("b", 8, 9, 0, "X", "x"), ("b", 9, 8, 0, "Y", "y")], "book_id string, toc_id int, parent_id int, pos int, title string, href string")
    assert rows(B.toc_titles(spark, toc)) == [("b", "a", "A"), ("b", "b", "B")]


def test_shared_resources_go_to_every_part(spark):
    res = spark.createDataFrame([("b", "s.css", False), ("b", "c.jpg", True), ("b", "Text/Capitulo0001.xhtml", False), ("b", "o.xhtml", None)], "book_id string, href string, is_cover boolean")
    s = spine(spark, 4)
    assert rows(B.shared_resources(res, s, B.split_in_parts(s, 2))) == [("b", 1, "o.xhtml"), ("b", 1, "s.css"), ("b", 2, "o.xhtml"), ("b", 2, "s.css")]


def test_metadata_defaults(spark):
    schema = "book_id string, titles array<string>, authors array<struct<first:string,last:string>>, identifiers array<string>, language string, subjects array<string>, descriptions array<string>"
    m = spark.createDataFrame([("a", None, None, None, None, [], None), ("b", ["T"], [("N", None)], [], "es", ["x", "y"], ["d"])], schema)
    assert rows(B.metadata_fields(m)) == [("a", None, "Desconocido", "No especificados.", "No disponible."), ("b", "T", "N ", "x, y", "d")]
    page = m.select(B.info_page(F.lit("a<b"), F.lit(" "), F.lit(None).cast("string"), F.lit("s"), F.lit(1), F.lit(2), None, "language")).collect()
    assert "<h1>a&lt;b</h1>" in page[0][0] and "Desconocido" in page[0][0] and "Sitio" not in page[0][0] and "<dd>es</dd>" in page[1][0]


def test_text_of_a_tag_has_its_references_decoded(spark):
    from tintero.functions import text_rules as R

    rows_ = ["<h1>A &amp; B &#225;&#xE9;&ntilde; &nada; &#x1F600; 5 & 6</h1>", "<h1> x&nbsp;&nbsp;y </h1>", "<p>z</p>", None, "<H1 class='a'>s<b>t</b></H1>", "<h1>&lt;b&gt; &amp;amp;</h1>"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows_)], "k int, h string").orderBy("k").select(R.tag_text("h", "h1")).collect()]
    assert got == ["A & B áéñ &nada; \U0001f600 5 & 6", "x y", None, None, "st", "<b> &amp;"]


def test_titles_stop_at_line_ends_as_the_rules_say(spark):
    from tintero.functions import text_rules as R

    df = spark.createDataFrame([("Capítulo 3: A",), ("x\nCapítulo 3: A",), ("Capítulo 3: A\nB",), ("12 - Uno",), ("12",)], "t string")
    assert [r[0] for r in df.select(R.standard_title("t")).collect()] == ["Capítulo 3: A", None, None, "Capítulo 12: Uno", None]


def test_chapter_links_by_path(spark):
    urls = ["/capitulo/1", "/novelas/x/capitulo-2", "/novelas/x", "/x/capitulo-3", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert rows(X.distinct_chapter_links(df)) == [("/capitulo/1",), ("/novelas/x/capitulo-2",)] and X.distinct_chapter_links(df, dashed=True).count() == 3


def test_sections_find_their_part_whatever_its_size(spark):
    s = spine(spark, 230)
    plan = spark.createDataFrame([("b", 1, 4, 0, 0), ("b", 2, 4, 1, 180), ("b", 3, 4, 181, 199), ("b", 4, 4, 300, 310), ("b", 5, 4, 9, 3)], "book_id string, part int, total_parts int, start_idx int, end_idx int")
    assert rows(B.sections_of_parts(s, plan).groupBy("part").count()) == [(1, 1), (2, 180), (3, 19)]


def test_closure_follows_long_chains_to_their_end(spark):
    links = spark.range(1100).selectExpr("CAST(id AS STRING) AS url", "CAST(id + 1 AS STRING) AS next_url")
    start = spark.createDataFrame([("0",)], "url string")
    assert X.closure(spark, start, links).count() == 1101
    assert X.closure(spark, start, links, depth=5).count() == 6


@pytest.mark.parametrize("width", [3, 100_000])
def test_places_without_a_whole_group_in_a_task(spark, width):
    from tintero.operators.position import by_number, by_order

    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", None]), rng.randint(-20, 60) if k else None, f"n{rng.randint(0, 9)}", k) for k in range(120)]
    df = spark.createDataFrame(data, "g string, n int, name string, k int").repartition(5)
    got = by_number(df, "g", "n", "pos", width).collect()
    for g in ("a", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert [r.n for r in mine] == sorted((r.n for r in mine), key=lambda n: (n is not None, n))
    named = by_order(df, "g", ["name", "k"]).collect()
    for g in ("a", None):
        mine = sorted((r for r in named if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine))) and [(r.name, r.k) for r in mine] == sorted((r.name, r.k) for r in mine)
    assert by_number(df.limit(0), "g", "n").count() == 0


def test_asof_with_ties_and_ends(spark):
    have = spark.createDataFrame([("b", n) for n in (2, 2, 5, 9)], "book_id string, chapter_no int")
    ask = spark.createDataFrame([("b", n) for n in (1, 2, 6, 9, 10, 2)] + [("z", 1)], "book_id string, chapter_no int")
    assert {tuple(r) for r in B.next_existing(ask, have).collect()} == {("b", 1, 2, None), ("b", 2, 2, 2), ("b", 6, 9, 5), ("b", 9, 9, 9), ("b", 10, None, 9), ("z", 1, None, None)}


def test_split_modes(spark):
    s = spine(spark, 7)
    ends = spark.createDataFrame([("b", 3), ("b", 9)], "book_id string, end_no int")
    assert B.split_plan(s, "parts", parts=2).count() == 2 and B.split_plan(s, "chunks", chunk=3).count() == 3 and B.split_plan(s, "range", first=1, last=7).count() == 1
    assert rows(B.split_plan(s, "custom", ends=ends), "part", "first_chapter", "last_chapter") == [(1, 1, 3), (2, 4, 7)]
    with pytest.raises(ValueError):
        B.split_plan(s, "none")


def test_pages_to_chapters(spark):
    from tintero.plans.flows import pages_to_chapters

    pages = spark.createDataFrame([(1, "https://novela.x/capitulo-3", "<article><h1>Capítulo 3: A</h1><p>x</p></article>"), (2, "https://novela.x/y", "nada"), (3, "https://novela.x/z", "<article><h1>Prólogo</h1><p>x</p></article>")], "page_id long, url string, html string")
    chapters, rejects = pages_to_chapters(pages, config(spark))
    assert rows(chapters, "page_id", "title", "file_name")[0] == (1, "Capítulo 3: A", "Capitulo0003.xhtml") and chapters.count() == 2 and chapters.where("page_id = 3").first().file_name is None
    assert rows(rejects, "page_id", "reason") == [(2, "no content")]
