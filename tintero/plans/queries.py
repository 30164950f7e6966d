"""One query per operator over the whole test tables, and the SQL that DuckDB compares it with."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from html import unescape
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..operators import audit as A
from ..operators import book as B
from ..operators import extract as X
from ..operators import normalize as N
from ..operators import select as S
from ..operators.position import by_number
from ..operators.sites import dispatch
from ..sources import archive as Z
from ..sources import folders as D
from ..sources.store import checkpointed, shared_folder
from ..streaming import pages as P
from . import flows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# Building blocks of the SQL.  RE2 folds more letters than java.util.regex, so the chapter word is spelt out.
CAP = "[Cc][Aa][Pp][Iií][Tt][Uu][Ll][Oo]"


def sql_text(html: str) -> str:
    """Text of markup: tags and unseen characters dropped, the usual references decoded, blanks collapsed."""
    t = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for name, code in sorted((k, v) for k, v in name2codepoint.items() if 160 <= v < 256 or k in ("quot", "lt", "gt", "amp", "euro", "mdash", "hellip")):
        t = f"replace({t}, '&{name};', chr({code}))" if name != "amp" else t
    return sql_collapse(f"replace({sql_windows(t)}, '&amp;', '&')")


def sql_windows(t: str) -> str:
    """Numbered references from 128 to 159 as the characters that browsers take them for."""
    for code in range(128, 160):
        t = f"replace({t}, '&#{code};', '{unescape(f'&#{code};')}')"
    return t


def sql_collapse(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace({t}, '[\\x{{200b}}\\x{{ad}}]', '', 'g'), '[ \\t\\n\\f\\r\\x{{a0}}]+', ' ', 'g'), ' ')"


def sql_tag(html: str, tag: str) -> str:
    there = f"regexp_matches({html}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>')"
    inner = f"regexp_extract({html}, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1)"
    return f"CASE WHEN {there} THEN {sql_text(inner)} END"


def sql_first(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def sql_heading(text: str) -> str:
    return f"coalesce(regexp_matches({text}, '^{CAP}\\s+\\d+.*\\w.*'), false)"


def sql_title(text: str) -> str:
    t = sql_trim(f"replace({text}, chr(65533), '\u2019')")
    named, numbered = f"\\A.*{CAP}\\s*(\\d+)[\\s:\u2013—.-]?\\s*(.*)\\z", "\\A(\\d+)[\\s:\u2013—.-]+\\s*([^<]+.*)\\z"

    def made(p: str) -> str:
        name = sql_trim(f"regexp_extract({t}, '{p}', 2)")
        return f"'Capítulo ' || regexp_extract({t}, '{p}', 1) || ': ' || CASE WHEN {name} = '' THEN '{R.UNTITLED}' ELSE {name} END"

    return f"CASE WHEN regexp_matches({t}, '{named}') THEN {made(named)} WHEN regexp_matches({t}, '{numbered}') THEN {made(numbered)} END"


_STANDARD, _INITIALS, _URL = "(?:[Cc][Aa][Pp][íIi][Tt][Uu][Ll][Oo]|[Cc][Hh]\\.|[Vv][Oo][Ll]\\.|[Ee][Pp][Ii][Ss][Oo][Dd][Ii][Oo])\\s*(\\d+)", "^[A-Za-z]{2,5}\\s+(\\d+)", f"{CAP}[-_\\s]*?(\\d+)"


def sql_numbered(source: str, keep: str) -> str:
    """Chapter numbers of (text, url) rows by the cascade."""
    return f"""
        SELECT {keep}, CASE WHEN label > 0 THEN label WHEN digits IS NOT NULL AND label IS NULL THEN NULL ELSE CASE WHEN fallback > 0 THEN fallback END END AS chapter_no,
               CASE WHEN label > 0 THEN 'text' ELSE 'url' END AS source
        FROM (SELECT *, TRY_CAST(digits AS INTEGER) AS label FROM (SELECT *, coalesce({sql_first("text", _STANDARD)}, {sql_first("text", _INITIALS)}, {sql_first("text", "(\\d+)")}) AS digits,
              TRY_CAST(coalesce({sql_first("url", _URL)}, {sql_first("url", "(\\d+)")}) AS INTEGER) AS fallback FROM ({source})))"""


# Extraction

_DISPATCH_SQL = """SELECT p.page_id, p.url, arg_min(c.site, c.priority) AS site FROM pages p LEFT JOIN site_config c
    ON CASE WHEN c.case_insensitive THEN contains(lower(p.url), lower(c.url_token)) ELSE contains(p.url, c.url_token) END GROUP BY p.page_id, p.url"""


@query(_DISPATCH_SQL)
def site_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "site_config")).select("page_id", "url", "site")


@query(
    f"""SELECT p.page_id, d.site, {sql_text("regexp_extract(p.html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title FROM pages p JOIN ({_DISPATCH_SQL}) d USING (page_id)
    WHERE regexp_matches(p.html, '(?i)<(?:div class="(?:entry-content|texto|post-content)"|div id="chapter-content"|article|td class="texto")')"""
)
def extract_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.extract(table(spark, sf_dir, "pages"), table(spark, sf_dir, "site_config"))
    return X.chapters_of(found).select("page_id", "site", "title")


@query("""SELECT page_id, url, 'no content' AS reason FROM pages WHERE NOT regexp_matches(html, '(?i)<(?:div class="(?:entry-content|texto|post-content)"|div id="chapter-content"|article|td class="texto")')""")
def extract_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rejects_of(X.extract(table(spark, sf_dir, "pages"), table(spark, sf_dir, "site_config")))


def sql_decoded(t: str) -> str:
    """Named references other than those of markup as characters."""
    for name, code in sorted((k, v) for k, v in name2codepoint.items() if 160 < v < 256 or k in ("euro", "mdash", "hellip")):
        t = f"replace({t}, '&{name};', chr({code}))"
    return f"replace(replace({sql_windows(t)}, '&nbsp;', '&#160;'), '&quot;', chr(34))"


# The content of a page as a browser's tree writes it: no scripts, blocks outside paragraphs, void elements closed.
_CONTENT_SQL = sql_decoded("regexp_replace(regexp_extract(html, '(?s)<div class=\"entry-content\">(.*)</div></body>', 1), '(?s)<script>.*?</script>', '', 'g')")
for _pattern, _new in (("<p>(<(?:hr|table|aside|h[1-6]|ul|ol|blockquote|div|pre|section)\\b.*)</p>", "<p></p>\\1<p></p>"), ("<(hr|br|img[^>]*?) ?/?>", "<\\1 />")):
    _CONTENT_SQL = f"regexp_replace({_CONTENT_SQL}, '{_pattern}', '{_new}', 'g')"


@query(f"""SELECT page_id, {sql_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, {_CONTENT_SQL} AS content_html FROM pages WHERE contains(html, '<div class="entry-content">')""")
def extract_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chapters_of(X.extract(table(spark, sf_dir, "pages"), table(spark, sf_dir, "site_config"))).select("page_id", "title", "content_html")


# Selectors and what they match in the pages' regular markup: (selector, region, element).
_SELECTORS = (
    ("h1.entry-title", "html", '<h1 class="entry-title">[^<]*</h1>'), ("ul.lista > li a[href]", """regexp_extract(html, '(?s)<ul class="lista">.*?</ul>')""", '<a href="[^"]*">[^<]*</a>'), ("nav a[href='/']", "html", '<a href="/">Inicio</a>'), ("head > title, #nada", "html", "<title>[^<]*</title>"),
)


@query(" UNION ALL ".join(
    f"""SELECT page_id, '{s.replace("'", "''")}' AS selector, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, regexp_extract(unnest(m), '^<(\\w+)', 1) AS tag, {sql_text("unnest(m)")} AS text FROM (SELECT page_id, regexp_extract_all({region}, '{element}') AS m FROM pages)""" for s, region, element in _SELECTORS
))
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.selected(table(spark, sf_dir, "pages", "page_id", "html"), tuple(s for s, _, _ in _SELECTORS))


_ENTRIES_SQL = """SELECT index_url, CAST(pos - 1 AS INTEGER) AS pos, regexp_extract(item, 'href="([^"]*)"', 1) AS url, regexp_extract(item, '>([^<]*)</a>', 1) AS text FROM (
    SELECT url AS index_url, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (SELECT url, regexp_extract_all(regexp_extract(html, '(?s)<ul class="lista">.*?</ul>'), '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages))"""


@query(_ENTRIES_SQL)
def index_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.index_entries(table(spark, sf_dir, "pages"), table(spark, sf_dir, "site_config"))


@query(f"SELECT * FROM ({sql_numbered(_ENTRIES_SQL, 'index_url, pos, url')}) WHERE chapter_no > 0")
def index_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.numbered_links(X.index_entries(table(spark, sf_dir, "pages"), table(spark, sf_dir, "site_config")))


@query(sql_numbered("SELECT chapter_id, title AS text, url FROM chapters", "chapter_id").replace("CASE WHEN label > 0 THEN 'text' ELSE 'url' END", "CASE WHEN label > 0 THEN 'text' WHEN digits IS NOT NULL AND label IS NULL OR NOT coalesce(fallback > 0, false) THEN NULL ELSE 'url' END"))
def chapter_number_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, source = R.chapter_number("title", "url")
    return table(spark, sf_dir, "chapters", "chapter_id", "title", "url").select("chapter_id", number.alias("chapter_no"), source.alias("source"))


_INDEX_SQL = """SELECT index_url, chapter_no, url FROM (SELECT *, row_number() OVER (PARTITION BY index_url, chapter_no ORDER BY seen_at DESC NULLS LAST, pos DESC, url DESC) AS rn
    FROM chapter_links WHERE chapter_no IS NOT NULL) WHERE rn = 1"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "chapter_links", "index_url", "chapter_no", "url", "pos", "seen_at")
    return X.last_wins(links, ["index_url", "chapter_no"], ["seen_at", "pos"])


@query(_INDEX_SQL)
def chapter_index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query("SELECT DISTINCT url FROM (SELECT CASE WHEN pos % 2 = 0 THEN replace(url, '/capitulo-', '/capitulo/') ELSE url END AS url FROM chapter_links) WHERE contains(url, '/capitulo/') OR contains(url, '/novelas/') AND contains(url, 'capitulo')")
def distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "chapter_links", "url", "pos")
    return X.distinct_chapter_links(links.select(F.when(F.col("pos") % 2 == 0, F.replace("url", F.lit("/capitulo-"), F.lit("/capitulo/"))).otherwise(F.col("url")).alias("url")))


@query("SELECT DISTINCT url FROM chapter_links WHERE contains(url, '/capitulo/') OR contains(url, '/novelas/') AND contains(url, 'capitulo') OR contains(url, '/capitulo-')")
def distinct_links_dashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.distinct_chapter_links(table(spark, sf_dir, "chapter_links", "url"), dashed=True)


@query(f"""WITH RECURSIVE idx AS ({_INDEX_SQL}), chain AS (SELECT index_url, chapter_no, url, lead(url) OVER (PARTITION BY index_url ORDER BY chapter_no) AS next_url FROM idx),
    edges AS (SELECT url, min(next_url) AS next_url FROM chain WHERE next_url IS NOT NULL AND url <> next_url GROUP BY url), starts AS (SELECT DISTINCT url FROM chain WHERE chapter_no = 1),
    walk AS (SELECT url AS start, url FROM starts UNION SELECT w.start, e.next_url FROM walk w JOIN edges e ON w.url = e.url) SELECT start, url FROM walk""")
def next_page_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = by_number(_index(spark, sf_dir), "index_url", "chapter_no")
    after = chain.select("index_url", (F.col("pos") - 1).alias("pos"), F.col("url").alias("next_url"))
    links = chain.select("index_url", "pos", "url").join(after, ["index_url", "pos"]).select("url", "next_url")
    return X.closure(spark, chain.where("chapter_no = 1").select("url"), links, depth=1 << 24).select("start", "url")


@query(f"""SELECT url, url || '?p=2' AS next_url FROM ({_DISPATCH_SQL}) d JOIN (SELECT site, sel_next FROM site_config) USING (site) WHERE sel_next IS NOT NULL AND page_id % 3 <> 0""")
def next_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page gets a next link, a third of them one to themselves; the sites that name a selector follow it."""
    link = F.concat(F.lit('<a class="next" href="'), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.lit("?p=2")), F.lit('">»</a></body>'))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</body>"), link))
    return X.next_pages(pages, table(spark, sf_dir, "site_config"))


# Selection


@query(f"SELECT * FROM ({_INDEX_SQL}) WHERE chapter_no BETWEEN 10 AND 25")
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_chapters(_index(spark, sf_dir), "range", first=10, last=25)


@query(f"SELECT * FROM ({_INDEX_SQL}) WHERE chapter_no <= 30")
def select_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_chapters(_index(spark, sf_dir), "up_to", last=30)


@query(f"SELECT * FROM ({_INDEX_SQL}) WHERE chapter_no = 7")
def select_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_chapters(_index(spark, sf_dir), "one", number=7)


def _wanted(spark: SparkSession) -> DataFrame:
    return S.requested_numbers(spark.createDataFrame([("10, 25",), ("3,  99999 ",), ("4, x",), (None,)], "request string"))


@query(f"SELECT * FROM ({_INDEX_SQL}) WHERE chapter_no IN (10, 25, 3, 99999)")
def select_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_chapters(_index(spark, sf_dir), "list", wanted=_wanted(spark))


@query(f"SELECT n AS chapter_no FROM (VALUES (10), (25), (3), (99999)) w(n) WHERE n NOT IN (SELECT chapter_no FROM ({_INDEX_SQL}))")
def select_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.not_found(_index(spark, sf_dir), _wanted(spark))


# Normalisation and audits


@query(f"SELECT chapter_id, new_title, new_title IS DISTINCT FROM title AS changed FROM (SELECT chapter_id, title, {sql_title('title')} AS new_title FROM chapters) WHERE new_title IS NOT NULL")
def title_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "chapter_id", "title").withColumn("new_title", R.standard_title("title")).where("new_title IS NOT NULL")
    return c.select("chapter_id", "new_title", (F.col("new_title") != F.col("title")).alias("changed"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "chapter_id", "book_id", "file_name", "title", "content_html")
    return c.select("chapter_id", "book_id", "file_name", "title", R.tag_text("content_html", "h1").alias("h1"))


_HEADS_SQL = f"SELECT chapter_id, book_id, file_name, title, {sql_tag('content_html', 'h1')} AS h1 FROM chapters"


@query(f"SELECT chapter_id, h1 FROM ({_HEADS_SQL}) WHERE h1 IS NULL OR h1 = '' OR NOT {sql_heading('h1')}")
def title_format_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.format_problems(_heads(spark, sf_dir)).select("chapter_id", "h1")


@query(f"SELECT chapter_id, h1, title FROM ({_HEADS_SQL}) WHERE h1 IS NULL OR title IS NULL OR {sql_trim('h1')} <> {sql_trim('title')}")
def h1_title_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.title_mismatches(_heads(spark, sf_dir)).select("chapter_id", "h1", "title")


@query(f"SELECT count(*) AS n_files, count_if(h1 IS NULL OR h1 = '' OR NOT {sql_heading('h1')}) AS n_changed, book_id FROM ({_HEADS_SQL}) GROUP BY book_id")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("h1").isNull() | (F.col("h1") == "") | ~R.valid_heading("h1")
    return A.changed_count(_heads(spark, sf_dir).withColumn("changed", bad), "book_id")


@query(
    f"""WITH f AS (SELECT chapter_id, regexp_extract_all(content_html, '(?is)<h([1-4])(?:\\s[^>]*)?>.*?</h[1-4]>', 1) AS levels, regexp_extract_all(content_html, '(?is)<h[1-4](?:\\s[^>]*)?>(.*?)</h[1-4]>', 1) AS texts FROM chapters),
    e AS (SELECT CAST(chapter_id AS VARCHAR) AS id, CAST(unnest(levels) AS INTEGER) AS level, {sql_text("unnest(texts)")} AS text, CAST(generate_subscripts(levels, 1) - 1 AS INTEGER) AS pos FROM f),
    v AS (SELECT *, {sql_heading("text")} AS is_valid FROM e)
    SELECT id, level, pos, is_valid, is_valid AND row_number() OVER (PARTITION BY id, level, is_valid ORDER BY pos) = 1 AS keep FROM v"""
)
def heading_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.heading_report(table(spark, sf_dir, "chapters", "chapter_id", "content_html"), "chapter_id", "content_html").select("id", "level", "pos", "is_valid", "keep")


def _text(html: str) -> Column:
    """All visible text of regular markup."""
    return R.collapse(R.decoded(F.regexp_replace(html, "<[^>]*>", "")))


_H = "(?is)<h[1-4](?:\\s[^>]*)?>.*?</h[1-4]>"


@query(
    f"""WITH f AS (SELECT CAST(chapter_id AS VARCHAR) AS id, content_html, regexp_extract_all(content_html, '{_H}') AS heads, regexp_split_to_array(content_html, '{_H}') AS pieces FROM chapters),
    e AS (SELECT id, unnest(heads) AS head, generate_subscripts(heads, 1) AS pos FROM f),
    v AS (SELECT *, lower(substr(head, 3, 1)) AS level, {sql_heading(sql_text("regexp_extract(head, '(?is)^<h[1-4](?:[ ][^>]*)?>(.*)</h[1-4]>$', 1)"))} AS valid FROM e),
    k AS (SELECT *, valid AND row_number() OVER (PARTITION BY id, level, valid ORDER BY pos) = 1 AS keep FROM v),
    g AS (SELECT id, list(CASE WHEN keep THEN head ELSE '' END ORDER BY pos) AS kept, bool_or(NOT keep) AS changed FROM k GROUP BY id)
    SELECT f.id, coalesce(g.changed, false) AS changed, {sql_text("CASE WHEN g.changed THEN pieces[1] || array_to_string(list_transform(list_zip(kept, pieces[2:]), lambda x: x[1] || x[2]), '') ELSE content_html END")} AS text
    FROM f LEFT JOIN g USING (id)"""
)
def heading_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = N.cleaned(table(spark, sf_dir, "chapters", "chapter_id", "content_html"), "chapter_id", "content_html")
    return done.select("id", "changed", _text("content").alias("text"))


def _place_sql() -> str:
    """(page_id, html, place, old_title): where a page's title is sought in regular markup."""
    places = [(t, f"(?is)<{t}(?:\\s[^>]*)?>(.*?)</{t}>") for t in ("h1", "h2", "h3", "h4")] + [("p > strong", "(?is)<p(?:\\s[^>]*)?><strong>(.*?)</strong>"), ("p", "(?is)<p(?:\\s[^>]*)?>(.*?)</p>"), ("b", "(?is)<b>(.*?)</b>")]
    place = "CASE " + " ".join(f"WHEN regexp_matches(html, '{p}') THEN '{t}'" for t, p in places) + " END"
    text = "CASE " + " ".join(f"WHEN place = '{t}' THEN regexp_extract(html, '{p}', 1)" for t, p in places) + " END"
    return f"SELECT page_id, html, place, {sql_text(text)} AS old_title FROM (SELECT *, {place} AS place FROM pages)"


_TITLES_SQL = f"SELECT *, {sql_title('old_title')} AS new_title FROM ({_place_sql()}) WHERE place IS NOT NULL"


@query(f"SELECT CAST(page_id AS VARCHAR) AS id, place, CASE WHEN place = 'p > strong' THEN 'strong' ELSE place END AS tag, old_title, new_title, place <> 'h1' AS promote FROM ({_TITLES_SQL}) WHERE new_title IS NOT NULL AND (new_title <> old_title OR place <> 'h1')")
def title_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.title_changes(N.title_places(table(spark, sf_dir, "pages"), "page_id", "html"))


@query(f"""SELECT CAST(p.page_id AS VARCHAR) AS id, c.new_title, coalesce(c.new_title, {sql_tag("p.html", "title")}) AS title, coalesce(c.new_title, {sql_tag("p.html", "h1")}) AS h1
    FROM pages p LEFT JOIN (SELECT page_id, new_title FROM ({_TITLES_SQL}) WHERE new_title IS NOT NULL AND (new_title <> old_title OR place <> 'h1')) c USING (page_id)""")
def title_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = N.standardized(table(spark, sf_dir, "pages"), "page_id", "html")
    return done.select("id", "new_title", R.tag_text("content", "title").alias("title"), R.tag_text("content", "h1").alias("h1"))


_IMG = """<img(?:(?:"[^"]*"|''[^'']*''|[^''">])*(?:"[^"]*"|''[^'']*''|[^''">/]))?"""
_ISSUE_TESTS = (
    ("nbsp", "contains(c, '&nbsp;')"), ("markdown", "contains(c, 'markdown')"), ("xml_declaration", f"NOT starts_with({sql_trim('c')}, '<?xml')"), ("link", "regexp_matches(c, '(?i)<link[^>]*[^>/]>')"),
    ("hr", "regexp_matches(c, '(?i)<hr[^>]*/?>')"), ("img", f"regexp_matches(c, '(?i){_IMG}>')"), ("br", "len(regexp_extract_all(c, '(?i)<br>')) > len(regexp_extract_all(c, '(?i)<br>(?:</br>|\\s*/>)'))"),
)
_ISSUES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in _ISSUE_TESTS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT id, CAST(pos - 1 AS INTEGER) AS ord, code FROM (SELECT id, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos FROM (SELECT chapter_id AS id, {_ISSUES_SQL} AS codes FROM (SELECT chapter_id, content_html AS c FROM chapters WHERE content_html IS NOT NULL)))")
def markup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.issue_rows(table(spark, sf_dir, "chapters", "chapter_id", "content_html"), "chapter_id", "content_html")


@query(f"SELECT chapter_id AS id, array_to_string({_ISSUES_SQL}, ',') AS codes FROM (SELECT chapter_id, content_html AS c FROM chapters WHERE content_html IS NOT NULL) WHERE len({_ISSUES_SQL}) > 0")
def issues_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.issue_rows(table(spark, sf_dir, "chapters", "chapter_id", "content_html"), "chapter_id", "content_html")
    return A.issues_by_file(rows).select("id", F.array_join("codes", ",").alias("codes"))


def _repair_sql(c: str) -> str:
    t = f"replace(CASE WHEN starts_with({sql_trim(c)}, '<?xml') THEN {c} ELSE '{R.XML_DECLARATION}' || chr(10) || {c} END, '&nbsp;', '&#160;')"
    for pattern, new in (("(<link[^>]*[^>/])>", "\\1 />"), ("<hr[^>]*/?>", ""), (f"({_IMG})>", "\\1/>"), ("<markdown[^>]*>", ""), ("</markdown>", ""), ("<br>", "<br />")):
        t = f"regexp_replace({t}, '(?i){pattern}', '{new}', 'g')"
    return t


@query(f"SELECT chapter_id, CASE WHEN len({_ISSUES_SQL}) > 0 THEN {_repair_sql('c')} ELSE c END AS repaired FROM (SELECT chapter_id, content_html AS c FROM chapters WHERE content_html IS NOT NULL)")
def markup_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.repair(table(spark, sf_dir, "chapters", "chapter_id", "content_html").where("content_html IS NOT NULL"), "content_html").select("chapter_id", "repaired")


_CSS = '<link rel="stylesheet" type="text/css" href="../Styles/stylesheet.css" />'


@query(f"""SELECT page_id, CASE WHEN contains(html, 'href="../Styles/stylesheet.css"') THEN html ELSE regexp_replace(html, '(?i)</head>', '{_CSS}</head>', 'g') END AS linked FROM pages""")
def css_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.link_css(table(spark, sf_dir, "pages", "page_id", "html"), "html").select("page_id", "linked")


_GAPS_SQL = """SELECT m.book_id, CAST(g.n AS INTEGER) AS chapter_no FROM (SELECT book_id, max(chapter_no) AS m FROM chapters WHERE chapter_no > 0 GROUP BY book_id) m, LATERAL (SELECT unnest(generate_series(1, m.m)) AS n) g
    WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = m.book_id AND c.chapter_no = g.n)"""


@query(_GAPS_SQL)
def missing_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missing_chapters(table(spark, sf_dir, "chapters", "book_id", "chapter_no"))


@query(f"""SELECT s.book_id, s.n_found, s.max_no, coalesce(g.n_missing, 0) AS n_missing, coalesce(g.missing, '') AS missing FROM (SELECT book_id, count(*) AS n_found, max(chapter_no) AS max_no FROM chapters WHERE chapter_no IS NOT NULL GROUP BY book_id) s
    LEFT JOIN (SELECT book_id, count(*) AS n_missing, string_agg(chapter_no, ', ' ORDER BY chapter_no) AS missing FROM ({_GAPS_SQL}) GROUP BY book_id) g USING (book_id)""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missing_report(table(spark, sf_dir, "chapters", "book_id", "chapter_no"))


@query("SELECT chapter_id, book_id, file_name, printf('Capitulo%04d.xhtml', row_number() OVER (PARTITION BY book_id ORDER BY file_name, chapter_id)) AS new_name FROM chapters")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.rename_plan(table(spark, sf_dir, "chapters", "chapter_id", "book_id", "file_name"), "book_id", "file_name", "chapter_id")


@query("""SELECT book_id, min_by(n, file_name) AS first_no, max_by(n, file_name) AS last_no, count(*) AS total FROM (SELECT DISTINCT book_id, file_name, coalesce(TRY_CAST(nullif(regexp_extract(file_name, '(\\d+)', 1), '') AS INTEGER), 0) AS n FROM chapters
    WHERE NOT regexp_matches(lower(file_name), 'toc|info')) GROUP BY book_id""")
def first_last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_last_number(table(spark, sf_dir, "chapters", "book_id", "file_name").distinct(), "book_id", "file_name")


@query("""SELECT chapter_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(title, '(\\d+)', 1), '') AS INTEGER), 0) AS INTEGER) AS digits, TRY_CAST(nullif(regexp_extract(file_name, '(?i)(?:Capitulo|Cap|Chapter|Ch)(\\d+)\\.xhtml', 1), '') AS INTEGER) AS href_no,
    regexp_replace(file_name, '(?i)\\.epub$', '') AS stem, ['application/xhtml+xml', 'text/css', 'image/png', 'image/jpeg', 'application/x-truetype-font', 'application/octet-stream'][chapter_id % 6 + 1] AS media_type, printf('Capitulo%04d.xhtml', chapter_no) AS made FROM chapters""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "chapter_id", "title", "file_name", "chapter_no")
    made = F.when(F.col("chapter_no").isNotNull(), R.chapter_file("chapter_no"))
    ending = F.get(F.array(*[F.lit(x) for x in ("", ".CSS", ".png", ".JPeg", ".ttf", ".abc")]), (F.col("chapter_id") % 6).cast("int"))
    named = F.concat("file_name", ending)
    return c.select("chapter_id", R.title_digits("title").alias("digits"), R.href_number("file_name").alias("href_no"), R.stem("file_name").alias("stem"), R.media_type(named).alias("media_type"), made.alias("made"))


@query("""SELECT index_url, n AS chapters, t AS threads, n * CASE WHEN t <= 2 THEN 2.0::DOUBLE WHEN t <= 5 THEN 2.2 WHEN t = 6 THEN 2.8 WHEN t = 7 THEN 3.5 WHEN t = 8 THEN 4.2 WHEN t = 9 THEN 4.9 ELSE 5.5 END / t AS seconds, CAST(floor(n / 60) AS BIGINT) AS minutes, CAST(n % 60 AS BIGINT) AS rest
    FROM (SELECT index_url, count(DISTINCT chapter_no) AS n FROM chapter_links GROUP BY index_url), (SELECT unnest(generate_series(1, 10))::INTEGER AS t)""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "chapter_links", "index_url", "chapter_no").groupBy("index_url").agg(F.countDistinct("chapter_no").alias("chapters"))
    minutes, rest = R.minutes_seconds(F.col("chapters") * 1000)
    return n.withColumn("threads", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("*", R.download_seconds("chapters", "threads").alias("seconds"), minutes.alias("minutes"), rest.alias("rest"))


@query(f"""SELECT index_url, chapter_no, CAST(floor((row_number() OVER (PARTITION BY index_url ORDER BY chapter_no) - 1) / ceil(count(*) OVER (PARTITION BY index_url) / 5.0)) AS INTEGER) AS batch FROM ({_INDEX_SQL})""")
def work_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batches(_index(spark, sf_dir)).select("index_url", "chapter_no", "batch")


# Book algebra


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "spine", "book_id", "spine_idx", "href")


_N = "SELECT book_id, count(*) AS n FROM spine GROUP BY book_id"


def _parts_sql(inner: str) -> str:
    return f"""SELECT book_id, CAST(part AS INTEGER) AS part, CAST(total AS INTEGER) AS total_parts, CAST((part - 1) * size AS INTEGER) AS start_idx, CAST(least(part * size, n) - 1 AS INTEGER) AS end_idx
        FROM (SELECT *, unnest(generate_series(1, CAST(ceil(n / size) AS BIGINT))) AS part FROM ({inner}))"""


_PARTS_SQL = _parts_sql(f"SELECT book_id, n, CAST(ceil(n / 4.0) AS BIGINT) AS size, 4 AS total FROM ({_N}) WHERE n >= 4")


@query(_PARTS_SQL)
def split_nparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_in_parts(_spine(spark, sf_dir), 4)


@query(_parts_sql(f"SELECT book_id, n, 50 AS size, ceil(n / 50.0) AS total FROM ({_N})"))
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_in_chunks(_spine(spark, sf_dir), 50)


@query(f"SELECT book_id, 1 AS part, 1 AS total_parts, 4 AS start_idx, 19 AS end_idx FROM ({_N}) WHERE n >= 20")
def split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_range(_spine(spark, sf_dir), 5, 20)


_MAP_SQL = """SELECT book_id, chapter_no, max(spine_idx) AS spine_idx FROM (SELECT book_id, spine_idx, TRY_CAST(nullif(regexp_extract(href, '(?i)(?:Capitulo|Cap|Chapter|Ch)(\\d+)\\.xhtml', 1), '') AS INTEGER) AS chapter_no FROM spine) WHERE chapter_no IS NOT NULL GROUP BY book_id, chapter_no"""


@query(_MAP_SQL)
def chapter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chapter_map(_spine(spark, sf_dir))


_ENDS = (10, 11, 25, 60, 61, 200)


def _for_books(spark: SparkSession, sf_dir: str, values: tuple, name: str) -> DataFrame:
    books = table(spark, sf_dir, "metadata", "book_id").distinct()
    return books.select("book_id", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


@query(f"""WITH m AS ({_MAP_SQL}), e AS (SELECT unnest([10, 11, 25, 60, 61, 200]) AS end_no), r AS (SELECT end_no, lag(end_no, 1, 0) OVER (ORDER BY end_no) AS before FROM e),
    p AS (SELECT m.book_id, r.end_no, min(chapter_no) AS first_chapter, max(chapter_no) AS last_chapter, arg_min(spine_idx, chapter_no) AS start_idx, arg_max(spine_idx, chapter_no) AS end_idx FROM m JOIN metadata USING (book_id) JOIN r ON m.chapter_no > r.before AND m.chapter_no <= r.end_no GROUP BY m.book_id, r.end_no)
    SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY end_no) AS INTEGER) AS part, first_chapter, last_chapter, start_idx, end_idx FROM p""")
def split_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_custom(B.chapter_map(_spine(spark, sf_dir)), _for_books(spark, sf_dir, _ENDS, "end_no"))


@query(f"""WITH m AS ({_MAP_SQL}), q AS (SELECT DISTINCT book_id, unnest([1, 5, 40, 5000]) AS chapter_no FROM metadata)
    SELECT q.book_id, q.chapter_no, min(m.chapter_no) FILTER (m.chapter_no >= q.chapter_no) AS next_no, max(m.chapter_no) FILTER (m.chapter_no <= q.chapter_no) AS prev_no FROM q LEFT JOIN m USING (book_id) GROUP BY q.book_id, q.chapter_no""")
def asof_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.next_existing(_for_books(spark, sf_dir, (1, 5, 40, 5000), "chapter_no"), B.chapter_map(_spine(spark, sf_dir)))


@query(f"""SELECT s.book_id, s.spine_idx, s.href, CAST(s.pos AS INTEGER) AS pos, p.part, p.total_parts FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY spine_idx) - 1 AS pos FROM spine) s JOIN ({_PARTS_SQL}) p ON s.book_id = p.book_id AND s.pos BETWEEN p.start_idx AND p.end_idx""")
def part_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = _spine(spark, sf_dir)
    return B.sections_of_parts(spine, B.split_in_parts(spine, 4))


_REQUESTS = ((1, "Primera", 10), (2, "Segunda", 10), (3, "Tercera", 25), (4, "Nunca", 999999))


@query(f"""WITH m AS ({_MAP_SQL}), q AS (SELECT book_id, r.* FROM (SELECT DISTINCT book_id FROM metadata), (VALUES (1, 10), (2, 10), (3, 25), (4, 999999)) r(req_ord, after_chapter)),
    pages AS (SELECT q.book_id, m.spine_idx AS i, 1 AS kind_ord, row_number() OVER (PARTITION BY q.book_id ORDER BY m.spine_idx, req_ord) AS k FROM q JOIN m ON q.book_id = m.book_id AND q.after_chapter = m.chapter_no)
    SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY i, kind_ord, k) - 1 AS INTEGER) AS new_idx, href, kind FROM (SELECT book_id, spine_idx AS i, 0 AS kind_ord, 0 AS k, href, 'section' AS kind FROM spine
    UNION ALL SELECT book_id, i, kind_ord, k, 'info_libro_' || k || '.xhtml', 'page' FROM pages)""")
def insert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.insert_pages(_spine(spark, sf_dir), _requests(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(o).alias("req_ord"), F.lit(n).alias("name"), F.lit(c).alias("after_chapter")) for o, n, c in _REQUESTS])
    return table(spark, sf_dir, "metadata", "book_id").distinct().select("book_id", F.explode(rows).alias("r")).select("book_id", "r.*")


@query(f"""WITH m AS ({_MAP_SQL}), q AS (SELECT book_id, r.* FROM (SELECT DISTINCT book_id FROM metadata), (VALUES (1, 10), (2, 10), (3, 25), (4, 999999)) r(req_ord, after_chapter)),
    pages AS (SELECT q.book_id, m.spine_idx, row_number() OVER (PARTITION BY q.book_id ORDER BY m.spine_idx, req_ord) AS k FROM q JOIN m ON q.book_id = m.book_id AND q.after_chapter = m.chapter_no),
    top AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_idx) - 1 AS i, href FROM spine ), sizes AS (SELECT book_id, count(*) AS size FROM top GROUP BY book_id)
    SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY i, kind, k) - 1 AS INTEGER) AS pos, title, href FROM (SELECT book_id, i, 0 AS kind, 0 AS k, href AS title, href FROM top
    UNION ALL SELECT book_id, least(spine_idx, size - 1), 1, k, 'Libro ' || k, 'info_libro_' || k || '.xhtml' FROM pages JOIN sizes USING (book_id))""")
def insert_toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = _spine(spark, sf_dir)
    toc = spine.select("book_id", F.lit(None).cast("int").alias("parent_id"), F.col("spine_idx").alias("pos"), F.col("href").alias("title"), "href")
    return B.insert_toc_entries(toc, B.page_targets(spine, _requests(spark, sf_dir)))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.array(*[F.struct(F.lit(h).alias("href"), F.lit(c).alias("is_cover")) for h, c in (("Styles/stylesheet.css", False), ("Fonts/serif.ttf", False), ("Images/cover.jpg", True), ("Text/huerfano.xhtml", False))])
    own = table(spark, sf_dir, "metadata", "book_id").distinct().select("book_id", F.explode(other).alias("r")).select("book_id", "r.*")
    return own.unionByName(_spine(spark, sf_dir).select("book_id", "href", F.lit(False).alias("is_cover")))


@query(f"SELECT p.book_id, p.part, r.href FROM ({_PARTS_SQL}) p JOIN (SELECT DISTINCT book_id FROM metadata) USING (book_id), (VALUES ('Styles/stylesheet.css'), ('Fonts/serif.ttf'), ('Text/huerfano.xhtml')) r(href)")
def shared_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = _spine(spark, sf_dir)
    return B.shared_resources(_resources(spark, sf_dir), spine, B.split_in_parts(spine, 4))


@query("SELECT DISTINCT book_id, 'Images/cover.jpg' AS href FROM metadata")
def cover_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers = table(spark, sf_dir, "metadata", "book_id").distinct().withColumn("name", F.lit("cover.jpg"))
    return B.with_cover(_resources(spark, sf_dir), covers).where("is_cover").select("book_id", "href")


@query("""SELECT DISTINCT book_id, href, book_id = (SELECT min(book_id) FROM metadata) AND href = 'Images/otra.PNG' OR book_id <> (SELECT min(book_id) FROM metadata) AND href = 'Images/cover.jpg' AS is_cover, CASE WHEN book_id = (SELECT min(book_id) FROM metadata) AND href = 'Images/otra.PNG' THEN 'image/png' END AS media_type
    FROM metadata, (VALUES ('Images/cover.jpg'), ('Images/otra.PNG')) r(href)""")
def cover_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(h).alias("href"), F.lit(c).alias("is_cover")) for h, c in (("Images/cover.jpg", True), ("Images/otra.PNG", False))])
    own = table(spark, sf_dir, "metadata", "book_id").distinct().select("book_id", F.explode(both).alias("r")).select("book_id", "r.*").withColumn("media_type", F.lit(None).cast("string"))
    return B.updated_cover(own, own.agg(F.min("book_id")).first()[0], "Images/otra.PNG")


# A contents' tree: every tenth section holds the nine after it, and each appears once more under another title.
_TOC_SQL = """SELECT book_id AS book, pos + 1 AS toc_id, CASE WHEN pos % 10 = 0 THEN NULL ELSE pos - pos % 10 + 1 END AS parent_id, pos, 'Sección ' || pos AS title, href FROM (SELECT book_id, href, CAST(row_number() OVER (PARTITION BY book_id ORDER BY spine_idx) - 1 AS INTEGER) AS pos FROM spine)
    UNION ALL SELECT book_id, 1000000 + pos, NULL, 1000000 + pos, 'Otra ' || pos, href FROM (SELECT book_id, href, CAST(row_number() OVER (PARTITION BY book_id ORDER BY spine_idx) - 1 AS INTEGER) AS pos FROM spine)"""


@query(f"""WITH RECURSIVE t AS ({_TOC_SQL}), walk AS (SELECT book, toc_id, title, href, [pos] AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.book, t.toc_id, t.title, t.href, list_append(w.path, t.pos) FROM t JOIN walk w ON t.parent_id = w.toc_id AND t.book = w.book)
    SELECT s.book_id, s.spine_idx, s.href, coalesce(x.title, s.href) AS title FROM spine s LEFT JOIN (SELECT book, href, arg_min(title, path) AS title FROM walk GROUP BY book, href) x ON s.book_id = x.book AND s.href = x.href""")
def toc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = B.ordered_spine(_spine(spark, sf_dir))
    p = F.col("pos")
    tree = spine.select("book_id", (p + 1).alias("toc_id"), F.when(p % 10 != 0, p - p % 10 + 1).alias("parent_id"), "pos", F.concat(F.lit("Sección "), p.cast("string")).alias("title"), "href")
    again = spine.select("book_id", (p + 1000000).alias("toc_id"), F.lit(None).cast("int").alias("parent_id"), (p + 1000000).alias("pos"), F.concat(F.lit("Otra "), p.cast("string")).alias("title"), "href")
    return B.section_titles(_spine(spark, sf_dir), B.toc_titles(spark, tree.unionByName(again)))


_TOC_ROWS_SQL = f"""SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY file_name, h1 NULLS FIRST) AS INTEGER) AS ord, url_encode(file_name) AS href,
    replace(replace(replace(coalesce(h1, replace(file_name, '.xhtml', '')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS label FROM ({_HEADS_SQL}) WHERE lower(file_name) <> 'toc.xhtml'"""


@query(_TOC_ROWS_SQL)
def toc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.toc_rows(_heads(spark, sf_dir), "book_id", "file_name", "h1")


@query(f"""SELECT book_id, '{B.TOC_HEAD}' || string_agg('            <li><a href="' || href || '">' || label || '</a></li>' || chr(10), '' ORDER BY ord) || '{B.TOC_TAIL}' AS html FROM ({_TOC_ROWS_SQL}) GROUP BY book_id""")
def toc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.toc_pages(B.toc_rows(_heads(spark, sf_dir), "book_id", "file_name", "h1"), "book_id")


_META_SQL = f"""SELECT book_id, titles[1] AS title, CASE WHEN authors[1] IS NULL THEN '{R.NO_AUTHOR}' ELSE coalesce(authors[1].first, '') || ' ' || coalesce(authors[1].last, '') END AS author,
    CASE WHEN len(subjects) > 0 THEN array_to_string(subjects, ', ') ELSE '{R.NO_GENRES}' END AS genres, coalesce(descriptions[1], '{R.NO_SYNOPSIS}') AS synopsis FROM metadata"""


@query(_META_SQL)
def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.metadata_fields(table(spark, sf_dir, "metadata"))


@query("SELECT book_id, array_to_string(list_transform(string_split(array_to_string(subjects, ','), ','), lambda x: regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), '|') AS subjects FROM metadata WHERE array_to_string(subjects, ',') <> ''")
def metadata_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "metadata", "book_id", "subjects").withColumn("text", F.array_join("subjects", ","))
    return m.where("text <> ''").select("book_id", F.array_join(R.subjects_of("text"), "|").alias("subjects"))


@query("""SELECT book_id, array_to_string(titles, '|') AS titles, array_to_string(CASE WHEN book_id LIKE '%1' THEN ['Drama', 'Aventura'] ELSE subjects END, '|') AS subjects FROM metadata""")
def metadata_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "metadata")
    none = F.lit(None).cast("string")
    changes = m.where("book_id LIKE '%1'").select("book_id", none.alias("title"), F.lit("").alias("author"), F.lit("Drama, Aventura ").alias("genres"), none.alias("synopsis"))
    return B.assign_metadata(m, changes).select("book_id", F.array_join("titles", "|").alias("titles"), F.array_join("subjects", "|").alias("subjects"))


@query(f"SELECT p.book_id, p.part, coalesce(nullif(m.titles[1], ''), '{B.NO_TITLE}') || ' (Parte ' || p.part || ' de ' || p.total_parts || ')' AS title, m.language FROM ({_PARTS_SQL}) p LEFT JOIN metadata m USING (book_id)")
def part_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = B.split_in_parts(_spine(spark, sf_dir), 4)
    return B.part_metadata(table(spark, sf_dir, "metadata"), plan).select("book_id", "part", "title", "language")


def _sql_escape(t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _sql_default(t: str, d: str) -> str:
    return f"CASE WHEN {t} IS NULL OR trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' ') = '' THEN '{d}' ELSE {t} END"


@query(f"""SELECT book_id, '{B.XHTML_HEAD}  <title>Información del Libro</title>' || chr(10) || '{B.STYLE_LINK}  <style type="text/css">{B.INFO_STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '  <h1>' || {_sql_escape("coalesce(title, 'Libro')")}
    || '</h1>' || chr(10) || '  <hr/>' || chr(10) || '  <h2>Ficha Informativa</h2>' || chr(10) || '  <dl>' || chr(10) || '    <dt>Capítulos Incluidos:</dt>' || chr(10) || '    <dd>' || first_no || ' - ' || last_no || ' (Total: ' || total || ')</dd>' || chr(10) || '  </dl>' || chr(10)
    || '  <h2>Información General</h2>' || chr(10) || '  <dl>' || chr(10) || '    <dt>Título Original:</dt>' || chr(10) || '    <dd>' || {_sql_escape("coalesce(title, 'No disponible')")} || '</dd>' || chr(10) || '    <dt>Autor:</dt>' || chr(10) || '    <dd>' || {_sql_escape(_sql_default("author", R.NO_AUTHOR))} || '</dd>' || chr(10)
    || '    <dt>Géneros:</dt>' || chr(10) || '    <dd>' || {_sql_escape(_sql_default("genres", R.NO_GENRES))} || '</dd>' || chr(10) || '    <dt>Sinopsis:</dt>' || chr(10) || '    <dd>' || {_sql_escape(_sql_default("synopsis", R.NO_SYNOPSIS))} || '</dd>' || chr(10) || '  </dl>' || chr(10) || '</body>' || chr(10) || '</html>' AS html
    FROM ({_META_SQL}) JOIN ({SQL["first_last_number"]}) USING (book_id)""")
def info_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = B.metadata_fields(table(spark, sf_dir, "metadata")).join(first_last_number(spark, sf_dir), "book_id")
    return m.select("book_id", B.info_page(*[F.col(c) for c in ("title", "author", "genres", "synopsis", "first_no", "last_no", "total")]).alias("html"))


@query(
    SQL["info_page"].replace("    <dt>Capítulos", "    <dt>Nombre del Libro #:</dt>' || chr(10) || '    <dt>Capítulos").replace(" || ' (Total: ' || total || ')</dd>'", " || '</dd>'")
)
def part_info_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = B.metadata_fields(table(spark, sf_dir, "metadata")).join(first_last_number(spark, sf_dir), "book_id")
    return m.select("book_id", B.info_page(*[F.col(c) for c in ("title", "author", "genres", "synopsis", "first_no", "last_no")]).alias("html"))


@query(f"""SELECT book_id, '{B.XHTML_HEAD}  <title>' || t || '</title>' || chr(10) || '{B.STYLE_LINK}  <style type="text/css">{B.START_STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '  <h1>Libro 1</h1>' || chr(10) || '  <h2>' || t || '</h2>' || chr(10) || '  <hr/>' || chr(10) || '  <dl>' || chr(10)
    || '    <dt>Sitio de Extracción:</dt>' || chr(10) || '    <dd>ejemplo</dd>' || chr(10) || '  </dl>' || chr(10) || '</body>' || chr(10) || '</html>' AS html FROM (SELECT book_id, {_sql_escape("titles[1]")} AS t FROM metadata WHERE titles[1] IS NOT NULL)""")
def start_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "metadata", "book_id", "titles").select("book_id", F.try_element_at("titles", F.lit(1)).alias("t")).where("t IS NOT NULL")
    return m.select("book_id", B.start_page(F.col("t"), F.lit(1), F.lit("ejemplo"), F.lit(" ")).alias("html"))


@query(f"""SELECT chapter_id, '{B.XHTML_HEAD}  <title>' || t || '</title>' || chr(10) || '{B.STYLE_LINK}</head>' || chr(10) || '<body>' || chr(10) || '  <h1>' || t || '</h1>' || chr(10) || content_html || chr(10) || '</body>' || chr(10) || '</html>' AS xhtml FROM (SELECT chapter_id, {_sql_escape("title")} AS t, content_html FROM chapters)""")
def chapter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "chapter_id", "title", "content_html")
    return c.select("chapter_id", B.chapter_page("title", "content_html").alias("xhtml"))


# Archives


def _book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "book_id", "chapter_no", "file_name", "title", "content_html").where("content_html IS NOT NULL")
    one = c.groupBy("book_id", "file_name").agg(F.min_by(F.struct("title", "content_html"), F.struct("title", "content_html")).alias("c"))
    return one.select("book_id", "file_name", F.col("c.title").alias("title"), B.chapter_page(F.coalesce("c.title", F.lit("")), F.col("c.content_html")).alias("xhtml"))


def _page_sql(title: str, content: str) -> str:
    t = _sql_escape(title)
    return f"""'{B.XHTML_HEAD}  <title>' || {t} || '</title>' || chr(10) || '{B.STYLE_LINK}</head>' || chr(10) || '<body>' || chr(10) || '  <h1>' || {t} || '</h1>' || chr(10) || {content} || chr(10) || '</body>' || chr(10) || '</html>'"""


_LEAST_SQL = "SELECT book_id, file_name, title, content_html FROM (SELECT *, row_number() OVER (PARTITION BY book_id, file_name ORDER BY title NULLS FIRST, content_html) AS rn FROM chapters WHERE content_html IS NOT NULL) WHERE rn = 1"
_LATEST_SQL = "SELECT book_id, file_name, title, content_html FROM (SELECT *, row_number() OVER (PARTITION BY book_id, file_name ORDER BY fetched_at DESC NULLS LAST, chapter_id DESC) AS rn FROM chapters WHERE content_html IS NOT NULL) WHERE rn = 1"
_PACK_SQL = f"""WITH files AS (SELECT book_id AS archive, 'OEBPS/Text/' || file_name AS name, {_page_sql("coalesce(title, '')", "content_html")} AS data FROM ({_LEAST_SQL})), every AS (SELECT * FROM files UNION ALL SELECT DISTINCT archive, 'mimetype', 'application/epub+zip' FROM files)
    SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY name <> 'mimetype', name) - 1 AS INTEGER) AS seq, name, CASE WHEN name = 'mimetype' THEN 'STORED' ELSE 'DEFLATED' END AS method, strlen(data) AS size, CASE WHEN name = 'mimetype' THEN 749429103 END AS crc_stored FROM every"""


def _pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _book_files(spark, sf_dir)
    rows = f.select(F.col("book_id").alias("archive"), F.concat(F.lit("OEBPS/Text/"), "file_name").alias("name"), F.encode("xhtml", "UTF-8").alias("data"))
    mime = f.select(F.col("book_id").alias("archive")).distinct().select("archive", F.lit("mimetype").alias("name"), F.encode(F.lit("application/epub+zip"), "US-ASCII").alias("data"))
    return rows.unionByName(mime)


@query(_PACK_SQL)
def ocf_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Z.pack_plan(_pack_files(spark, sf_dir))
    return plan.select("archive", "seq", "name", "method", "size", F.when(F.col("method") == "STORED", F.col("crc")).alias("crc_stored"))


def _read_back(built: DataFrame) -> DataFrame:
    """(book_id, spine_idx, href, title, hash): what an archive's reading order, contents and files say."""
    found = checkpointed(built)
    read = Z.books(found)
    named = Z.toc_of(read).groupBy("book_id", "href").agg(F.min_by("title", "pos").alias("title"))
    files = Z.unpacked(Z.entries(found)).select(F.col("archive").alias("book_id"), F.regexp_replace("name", "^OEBPS/", "").alias("href"), F.md5("data").alias("hash"))
    return Z.spine_of(read).join(named, ["book_id", "href"], "left").join(files, ["book_id", "href"], "left").select("book_id", "spine_idx", "href", "title", "hash")


_IDX = "CAST(row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS INTEGER) AS spine_idx"


@query(f"""SELECT book_id, {_IDX}, 'Text/' || name AS href, title, hash FROM (SELECT book_id, '0' AS ord, 'info.xhtml' AS name, 'Información' AS title, NULL AS hash FROM metadata WHERE book_id IN (SELECT book_id FROM chapters WHERE content_html IS NOT NULL)
    UNION ALL SELECT book_id, '1' || file_name, file_name, replace(file_name, '.xhtml', ''), md5({_page_sql("coalesce(title, '')", "content_html")}) FROM ({_LATEST_SQL}) WHERE book_id IN (SELECT book_id FROM metadata))""")
def build_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = W.built_books(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "metadata"))
    return _read_back(built.select(F.col("book_id").alias("archive"), "content")).withColumn("hash", F.when(F.col("href") != "Text/info.xhtml", F.col("hash")))


@query(f"""SELECT book_id, {_IDX}, 'Text/' || name AS href, title, hash FROM (SELECT DISTINCT book_id || '_' || part AS book_id, -1 AS ord, 'info.xhtml' AS name, 'Información' AS title, NULL AS hash FROM ({_PARTS_SQL})
    UNION ALL SELECT s.book_id || '_' || p.part, s.pos, parse_filename(s.href), s.href, md5({_page_sql("coalesce(c.title, s.href)", "coalesce(c.content_html, '')")}) FROM ({_PARTS_SQL}) p JOIN (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY spine_idx) - 1 AS pos FROM spine) s
    ON s.book_id = p.book_id AND s.pos BETWEEN p.start_idx AND p.end_idx LEFT JOIN ({_LATEST_SQL}) c ON c.book_id = s.book_id AND c.file_name = parse_filename(s.href))""")
def split_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = _spine(spark, sf_dir)
    css = table(spark, sf_dir, "metadata", "book_id").distinct().select("book_id", F.lit("Styles/stylesheet.css").alias("href"), F.encode(F.lit("p {}"), "UTF-8").alias("data"), F.lit(False).alias("is_cover"))
    built = W.split_books(spine, B.split_in_parts(spine, 4), table(spark, sf_dir, "chapters"), table(spark, sf_dir, "metadata"), css)
    return _read_back(built.select(F.concat_ws("_", "book_id", "part").alias("archive"), "content")).withColumn("hash", F.when(F.col("href") != "Text/info.xhtml", F.col("hash")))


@query(f"SELECT book_id, {_IDX}, 'Text/' || ord AS href, title, hash FROM (SELECT book_id, file_name AS ord, coalesce(title, file_name) AS title, md5({_page_sql('coalesce(title, $$$$)', 'content_html')}) AS hash FROM ({_LEAST_SQL}))")
def epub_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _book_files(spark, sf_dir).select("book_id", F.col("file_name").alias("ord"), F.col("file_name").alias("name"), "title", "xhtml")
    m = table(spark, sf_dir, "metadata").select("book_id", F.try_element_at("titles", F.lit(1)).alias("title"), "authors", "language", "subjects", "descriptions", "identifiers")
    return _read_back(Z.build_books(f, m, ["book_id"]).select(F.col("book_id").alias("archive"), "content"))


def _odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of files per book, as people keep them: below a folder, with a stray file, and a name that leaves it."""
    one = table(spark, sf_dir, "metadata", "book_id").distinct()
    files = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("text")) for n, d in _ODD])
    return one.select(F.col("book_id").alias("archive"), F.explode(files).alias("f")).select("archive", "f.name", F.encode(F.concat("f.text", "archive"), "UTF-8").alias("data"))


_ODD = (
    ("libro/mimetype", "m"), ("libro/META-INF/container.xml", "c"), ("libro/OEBPS/Text/b.xhtml", "b"), ("libro/OEBPS/Text/a.xhtml", "a"), ("libro/OEBPS/content.opf", "o"), ("libro/OEBPS/Images/mimetype", "x"), ("libro/notas.txt", "n"), ("../fuera.txt", "f"), ("otro/z.txt", "z"),
)
_ODD_SQL = "SELECT DISTINCT book_id AS archive, f.name AS name, md5(f.text || book_id) AS hash FROM metadata, (VALUES " + ", ".join(f"('{n}', '{d}')" for n, d in _ODD) + ") f(name, text)"


@query(f"SELECT * FROM ({_ODD_SQL}) WHERE name <> '../fuera.txt'")
def archive_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Z.entries(Z.pack(_odd_files(spark, sf_dir), "zip"))
    return Z.unpacked(rows).select("archive", "name", F.md5("data").alias("hash"))


@query(f"SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY name) - 1 AS INTEGER) AS seq, name, hash, name <> '../fuera.txt' AS safe FROM ({_ODD_SQL})")
def zip_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.entries(Z.pack(_odd_files(spark, sf_dir), "zip")).select("archive", "seq", "name", F.md5("data").alias("hash"), "safe")


_LIFTED_SQL = f"SELECT archive, replace(name, 'libro/', '') AS name, hash FROM ({_ODD_SQL}) WHERE starts_with(name, 'libro/')"


def _lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.lifted(_odd_files(spark, sf_dir).where(F.startswith("name", F.lit("libro/"))))


@query(f"SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY name <> 'mimetype', name) - 1 AS INTEGER) AS seq, name, hash, CASE WHEN name = 'mimetype' THEN 'STORED' ELSE 'DEFLATED' END AS method FROM ({_LIFTED_SQL}) WHERE name = 'mimetype' OR NOT ends_with(name, '/mimetype')")
def lifted_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.entries(Z.pack(_lifted(spark, sf_dir))).select("archive", "seq", "name", F.md5("data").alias("hash"), "method")


@query("""SELECT DISTINCT book_id AS archive, CAST(n - 1 AS INTEGER) AS seq, name, ends_with(name, '/') AS is_dir FROM metadata, (SELECT unnest(x) AS name, generate_subscripts(x, 1) AS n FROM (SELECT ['mimetype', 'META-INF/', 'META-INF/container.xml', 'OEBPS/', 'OEBPS/Images/', 'OEBPS/Images/mimetype', 'OEBPS/Text/', 'OEBPS/Text/a.xhtml', 'OEBPS/Text/b.xhtml', 'OEBPS/content.opf'] AS x))""")
def folder_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.entries(Z.pack(_lifted(spark, sf_dir), "folder")).select("archive", "seq", "name", "is_dir")


@query("SELECT DISTINCT book_id AS archive, false AS has_mimetype, false AS has_meta_inf, false AS has_oebps FROM metadata")
def folder_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.structure(_odd_files(spark, sf_dir))


@query("SELECT DISTINCT book_id AS archive, true AS has_mimetype, true AS has_meta_inf, true AS has_oebps FROM metadata")
def lifted_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.structure(_lifted(spark, sf_dir))


_EMPTY = Z.skeleton("")


@query(
    f"SELECT archive, name, hash FROM ({_ODD_SQL}) UNION ALL SELECT DISTINCT book_id, n, h FROM metadata, (VALUES " + ", ".join(f"('{n}', '{hashlib.md5(d).hexdigest()}')" for _, n, d in _EMPTY) + ") e(n, h)"
    f" UNION ALL SELECT archive || ' 2', name, hash FROM ({_LIFTED_SQL})"
)
def folder_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders without a mimetype get an empty book's files, those with one (named with a 2 here) stay."""
    whole = _lifted(spark, sf_dir).withColumn("archive", F.concat("archive", F.lit(" 2")))
    return Z.completed(_odd_files(spark, sf_dir).unionByName(whole)).select("archive", "name", F.md5("data").alias("hash"))


def _loose(spark: SparkSession, sf_dir: str) -> str:
    """A folder of loose files, a page and two resources for each book of the metadata."""
    folder = f"{shared_folder(spark).removeprefix('file:').replace('//', '/').rstrip('/')}/files-{uuid.uuid4().hex}"
    one = table(spark, sf_dir, "metadata", "book_id").distinct()
    files = F.array(*[F.struct(F.concat(F.lit(a), "book_id", F.lit(z)).alias("name"), F.concat(F.lit(a), "book_id").alias("data")) for a, z in (("OEBPS/Text/", ".XHTML"), ("OEBPS/Text/sub/", ".xhtml"), ("OEBPS/Styles/", ".css"), ("OEBPS/Images/deep/", ".PNG"))])
    Z.save_files(one.select(F.explode(files).alias("f")).select("f.*"), "name", "data", folder)
    return folder


@query("SELECT 'book' AS book_id, CAST(row_number() OVER (ORDER BY book_id) AS INTEGER) AS ord, book_id || '.XHTML' AS file_name, 'OEBPS/Text/' || book_id AS content FROM (SELECT DISTINCT book_id FROM metadata)")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.xhtml_folder(spark, _loose(spark, sf_dir))


@query("""SELECT 'book' AS book_id, 'Styles/' || book_id || '.css' AS href, 'text/css' AS media_type, md5('OEBPS/Styles/' || book_id) AS hash FROM (SELECT DISTINCT book_id FROM metadata)
    UNION ALL SELECT 'book', 'Images/deep/' || book_id || '.PNG', 'image/png', md5('OEBPS/Images/deep/' || book_id) FROM (SELECT DISTINCT book_id FROM metadata)""")
def resource_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resource_folders(spark, _loose(spark, sf_dir)).select("book_id", "href", "media_type", F.md5("data").alias("hash"))


def _head_sql(t: str) -> str:
    return f"regexp_extract({t}, '{_NAMED_TITLE}', 1)"


_NAMED_TITLE = f"\\A.*{CAP}\\s*(\\d+)[\\s:\u2013—.-]?\\s*(.*)\\z"
_EDITED_SQL = f"""WITH files AS (SELECT book_id, file_name, {sql_collapse("coalesce(title, '')")} AS h1, coalesce(title, file_name) AS entry FROM ({_LEAST_SQL})),
    planned AS (SELECT *, {sql_trim("replace(h1, chr(65533), '\u2019')")} AS t FROM files), named AS (SELECT *, {sql_trim(f"regexp_extract(t, '{_NAMED_TITLE}', 2)")} AS name FROM planned),
    done AS (SELECT *, CASE WHEN h1 <> '' AND regexp_matches(t, '{_NAMED_TITLE}') THEN 'Capítulo ' || {_head_sql("t")} || ': ' || CASE WHEN name = '' THEN '{R.UNTITLED}' ELSE name END END AS new FROM named)"""


@query(_EDITED_SQL + " SELECT book_id, 'Text/' || file_name AS href, h1 AS old_title, new AS new_title FROM done WHERE new <> h1")
def book_heading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _book_files(spark, sf_dir).select("book_id", F.concat(F.lit("Text/"), "file_name").alias("href"), F.lit(R.XHTML).alias("media_type"), F.col("xhtml").alias("content"))
    css = files.select("book_id", F.lit("Styles/s.css").alias("href"), F.lit("text/css").alias("media_type"), F.lit("<h1>Capítulo 1 x</h1><title/>").alias("content")).distinct()
    toc = files.unionByName(css).select("book_id", "href", F.lit(None).cast("int").alias("parent_id"))
    return B.heading_changes(files.unionByName(css), toc)


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _book_files(spark, sf_dir).select("book_id", F.col("file_name").alias("ord"), F.col("file_name").alias("name"), "title", "xhtml")
    m = table(spark, sf_dir, "metadata").select("book_id", F.try_element_at("titles", F.lit(1)).alias("title"), "authors", "language", "subjects", "descriptions", "identifiers")
    return Z.build_books(f, m, ["book_id"]).select(F.col("book_id").alias("archive"), "content")


@query(_EDITED_SQL + f" SELECT book_id, {_IDX.replace('ord', 'file_name')}, 'Text/' || file_name AS href, CASE WHEN new <> h1 THEN new ELSE entry END AS title, coalesce(new, h1) AS h1, coalesce(new, h1) AS head FROM done")
def book_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books built, read, edited and written back, and what is in them then."""
    read, _, text = W.opened_books(W.edited_books(_built(spark, sf_dir)).select(F.col("book_id").alias("archive"), "content"))
    heads = text.select("book_id", "href", R.tag_text("content", "h1").alias("h1"), R.tag_text("content", "title").alias("head"))
    return Z.spine_of(read).join(Z.toc_of(read).select("book_id", "href", "title"), ["book_id", "href"]).join(heads, ["book_id", "href"]).select("book_id", "spine_idx", "href", "title", "h1", "head")


@query(
    f"""WITH f AS (SELECT book_id, 'Text/' || file_name AS href, {_page_sql("coalesce(title, '')", "content_html")} AS page FROM ({_LEAST_SQL})), h AS (SELECT book_id, href, regexp_extract_all(page, '{_H}') AS heads FROM f),
    e AS (SELECT book_id, href, unnest(heads) AS head, generate_subscripts(heads, 1) AS pos FROM h), t AS (SELECT *, lower(substr(head, 3, 1)) AS level, {sql_text("regexp_extract(head, '(?is)^<h[1-4](?:[ ][^>]*)?>(.*)</h[1-4]>$', 1)")} AS text FROM e),
    v AS (SELECT *, {sql_heading("text")} AS valid FROM t), k AS (SELECT *, valid AND row_number() OVER (PARTITION BY book_id, href, level, valid ORDER BY pos) = 1 AS keep FROM v)
    SELECT f.book_id, f.href, coalesce(string_agg(level || ' ' || text, '|' ORDER BY pos) FILTER (keep), '') AS headings FROM f JOIN k USING (book_id, href) GROUP BY f.book_id, f.href"""
)
def book_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of books built, read, cleaned and written back."""
    _, _, text = W.opened_books(W.cleaned_books(_built(spark, sf_dir)).select(F.col("book_id").alias("archive"), "content"))
    left = X.headings(text.withColumn("id", F.concat_ws("|", "book_id", "href")), "id", "content").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "level", "text").alias("t")))).alias("h"))
    named = text.select("book_id", "href", F.concat_ws("|", "book_id", "href").alias("id")).join(left, "id", "left")
    return named.select("book_id", "href", F.coalesce(F.array_join(F.transform("h", lambda x: x["t"]), "|"), F.lit("")).alias("headings"))


@query(f"SELECT book_id, 'Text/' || file_name AS href, h1, h1 AS title, true AS bad_form, false AS mismatch FROM (SELECT book_id, file_name, {sql_collapse("coalesce(title, '')")} AS h1 FROM ({_LEAST_SQL})) WHERE h1 = '' OR NOT {sql_heading('h1')}")
def book_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.book_problems(W.opened_books(_built(spark, sf_dir))[2])


@query(f"""SELECT book_id, {_IDX}, 'Text/' || name AS href, title, hash FROM (SELECT book_id, '0' AS ord, 'sinopsis.xhtml' AS name, 'Sinopsis' AS title, md5('{B.SYNOPSIS_HEAD.replace("'", "''")}<link rel="stylesheet" type="text/css" href="Styles/stylesheet.css" />' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || ' <h1>Sinopsis</h1>' || chr(10) || ' <p>' || replace(descriptions[1], chr(10), '<br/>')
        || '</p>' || chr(10) || ' <h2>Géneros</h2>' || chr(10) || ' <p>' || coalesce(array_to_string(subjects, ', '), '') || '</p>' || chr(10) || '</body>' || chr(10) || '</html>') AS hash FROM metadata WHERE coalesce(descriptions[1], '') <> '' AND book_id IN (SELECT book_id FROM chapters WHERE content_html IS NOT NULL)
    UNION ALL SELECT book_id, '1' || file_name, file_name, replace(file_name, '.xhtml', ''), md5({_page_sql("coalesce(title, '')", "content_html")}) FROM ({_LATEST_SQL}) WHERE book_id IN (SELECT book_id FROM metadata))""")
def older_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = W.older_books(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "metadata"))
    return _read_back(built.select(F.col("book_id").alias("archive"), "content"))


@query(f"""SELECT book_id, '{B.PLAIN_TOC_HEAD}' || string_agg('<li><a href="' || file_name || '">' || coalesce(h1, file_name) || '</a></li>' || chr(10), '' ORDER BY file_name, coalesce(h1, file_name)) || '{B.PLAIN_TOC_TAIL}' AS html FROM ({_HEADS_SQL}) GROUP BY book_id""")
def older_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.plain_toc_page(_heads(spark, sf_dir), "book_id", "file_name", "h1")


# Streams


def _drained(spark: SparkSession, sf_dir: str, name: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """A plan on the stream of a table's files, run to its end; the result lies in the shared folder."""
    out = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema, file = table(spark, sf_dir, name).schema, f"{name}.parquet"
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/{file}") if os.path.isdir(f"{sf_dir}/{file}") else spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(sf_dir)
    result = plan(source)
    spark.createDataFrame([], result.schema).write.parquet(f"{out}/data/none")
    # a batch that is run again overwrites its own folder
    write = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/data/{'all' if mode == 'complete' else k}")
    result.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")


@query("SELECT strftime(date_trunc('hour', seen_at), '%Y-%m-%d %H:%M:%S') AS window_start, index_url, chapter_no, arg_max(url, (seen_at, pos, url)) AS url FROM chapter_links WHERE chapter_no IS NOT NULL AND seen_at IS NOT NULL GROUP BY ALL")
def stream_latest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output is complete, so windows that the watermark would keep open, and late rows, are part of the result too."""
    return _drained(spark, sf_dir, "chapter_links", P.latest_links, "complete").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(SQL["extract_content"])
def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "site_config")
    return X.chapters_of(_drained(spark, sf_dir, "pages", lambda pages: P.extracted_stream(pages, config))).select("page_id", "title", "content_html")


@query("SELECT DISTINCT url FROM chapters WHERE fetched_at IS NOT NULL")
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that came again in the same run are dropped, whichever came first."""
    return _drained(spark, sf_dir, "chapters", P.first_deliveries).select("url")


@query(f"SELECT chapter_id, array_to_string({_ISSUES_SQL}, ',') AS codes, md5({SQL['markup_repair'].split(' AS repaired')[0].removeprefix('SELECT chapter_id, ')}) AS hash FROM (SELECT chapter_id, content_html AS c FROM chapters WHERE content_html IS NOT NULL)")
def stream_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _drained(spark, sf_dir, "chapters", lambda files: P.issue_stream(files.where("content_html IS NOT NULL").select("chapter_id", "content_html")))
    return done.select("chapter_id", F.array_join("issues", ",").alias("codes"), F.md5("repaired").alias("hash"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
