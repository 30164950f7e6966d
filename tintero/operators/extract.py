"""Pages to chapters and chapter links."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..functions.arrow import map_rows
from ..functions.html_tree import Element, parse, parse_selector
from .sites import dispatch

# Where content and titles are sought if a configuration's selectors find nothing, and what is noise.
CONTENT_FALLBACKS = ("div.skn-chp-chapter-content", "div#chapter-content", "div.entry-content", "article")
TITLE_FALLBACKS = ("h1[class*='title']", "h2[class*='title']", "h3.text-center", "p > strong", "strong", "h1", "h2", "h3", "h4", "b")
NOISE = "script, style, .publi, .adsb30, .wp-post-navigation, .zeno_font_resizer_container, .osny-nightmode, .saboxplugin-wrap, miad-block2, miad-block3"
# What a page with any noise has.
_NOISE_MARK = re.compile("script|style|publi|adsb30|wp-post-navigation|zeno_font_resizer_container|osny-nightmode|saboxplugin-wrap|miad-block", re.IGNORECASE)
CHAPTER_MARK = re.compile(r"Cap[ií]tulo\s*\d+", re.IGNORECASE | re.ASCII)

_CHAPTER = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("site", pa.string()), ("title", pa.string()), ("content_html", pa.string()), ("reason", pa.string())])
_LINK = pa.schema([("index_url", pa.string()), ("pos", pa.int32()), ("url", pa.string()), ("text", pa.string())])
_SELECTED = pa.schema([("page_id", pa.int64()), ("selector", pa.string()), ("pos", pa.int32()), ("tag", pa.string()), ("text", pa.string())])
_NEXT = pa.schema([("url", pa.string()), ("next_url", pa.string())])
_HEADING = pa.schema([("id", pa.string()), ("tag", pa.string()), ("level", pa.int32()), ("pos", pa.int32()), ("text", pa.string())])


def _first(root: Element, selector: str | None) -> Element | None:
    """First match; a missing or unreadable selector finds nothing."""
    if not selector:
        return None
    try:
        return root.first(selector)
    except ValueError:
        return None


def _element(found: tuple[int, Element] | None) -> Element | None:
    return None if found is None else found[1]


def extract_page(html: str | None, sel_content: str | None, sel_title: str | None) -> tuple[str | None, str | None, str | None]:
    """(title, content, None), or (None, None, reason) for a page that yields no chapter."""
    if not html:
        return None, None, "no html"
    root = parse(html)
    content, title = _first(root, sel_content), _first(root, sel_title)
    if title is None:
        title = _element(root.first_of(TITLE_FALLBACKS, lambda e: CHAPTER_MARK.search(e.text()) is not None))
    content = content if content is not None else _element(root.first_of(CONTENT_FALLBACKS))
    title = title if title is not None else root.first("title")
    if content is None or title is None:
        return None, None, "no content" if content is None else "no title"
    name = title.text()
    for e in content.select(NOISE) if _NOISE_MARK.search(html) else ():
        if e is not content:
            e.remove()
    if title.parent is content:
        title.remove()
    else:
        double = content.first_with_text(name)
        if double is content:
            content.children.clear()
        elif double is not None:
            double.remove()
    return name, content.inner_html().replace("&nbsp;", "&#160;"), None


def extract(pages: DataFrame, config: DataFrame, default_site: str | None = None) -> DataFrame:
    """(page_id, url, site, title, content_html, reason): chapters have no reason, rejects have nothing else."""
    source = dispatch(pages.select("page_id", "url", "html"), config, default_site=default_site).select("page_id", "url", "html", "site", "sel_content", "sel_title")

    def one(row: dict) -> list[dict]:
        title, content, reason = extract_page(row["html"], row["sel_content"], row["sel_title"])
        return [{"page_id": row["page_id"], "url": row["url"], "site": row["site"], "title": title, "content_html": content, "reason": reason}]

    return map_rows(source, one, _CHAPTER, "page_id long, url string, site string, title string, content_html string, reason string")


def chapters_of(extracted: DataFrame) -> DataFrame:
    return extracted.where("reason IS NULL").drop("reason")


def rejects_of(extracted: DataFrame) -> DataFrame:
    """Dead letters: every failed page with its reason; nothing is overwritten."""
    return extracted.where("reason IS NOT NULL").select("page_id", "url", "reason")


def index_entries(pages: DataFrame, config: DataFrame, default_site: str | None = None) -> DataFrame:
    """(index_url, pos, url, text) of every list element's link, before numbers are read."""
    source = dispatch(pages.select("page_id", "url", "html"), config, default_site=default_site).select("url", "html", "sel_list_item", "sel_link", "sel_number")

    def one(row: dict) -> list[dict]:
        if not row["html"]:
            return []
        root, out = parse(row["html"]), []
        try:
            items = root.select(row["sel_list_item"] or "a")
        except ValueError:
            return []
        for item in items:
            link = _first(item, row["sel_link"] or "a")
            link = link if link is not None else item if item.tag == "a" else None
            if link is None:
                continue
            href = link.attrs.get("href", "")
            try:
                url = urljoin(row["url"] or "", href) or href
            except ValueError:
                url = href
            number = row["sel_number"]
            label = _first(item, number) if number and number != "a" else None
            out.append({"index_url": row["url"], "pos": len(out), "url": url, "text": (label if label is not None else link).text()})
        return out

    return map_rows(source, one, _LINK, "index_url string, pos int, url string, text string")


def selected(pages: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """(page_id, selector, pos, tag, text) of every element that a selector matches, in document order; an unreadable selector is an error."""
    for s in selectors:
        parse_selector(s)

    def one(row: dict) -> list[dict]:
        root = parse(row["html"]) if row["html"] else None
        return [] if root is None else [{"page_id": row["page_id"], "selector": s, "pos": k, "tag": e.tag, "text": e.text()} for s in selectors for k, e in enumerate(root.select(s))]

    return map_rows(pages.select("page_id", "html"), one, _SELECTED, "page_id long, selector string, pos int, tag string, text string")


def numbered_links(entries: DataFrame) -> DataFrame:
    """(index_url, pos, chapter_no, url, source): entries with a positive number of their text or URL."""
    number, source = R.chapter_number("text", "url")
    return entries.select("index_url", "pos", number.alias("chapter_no"), "url", source.alias("source")).where("chapter_no > 0")


def last_wins(links: DataFrame, keys: list[str], order: list[str], value: str = "url") -> DataFrame:
    """One row per key: the value of the last row in the given order.  Pre-aggregates before its one shuffle."""
    best = F.struct(*[F.col(c) for c in order], F.col(value))
    return links.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max_by(value, best).alias(value))


def distinct_chapter_links(links: DataFrame, url_col: str = "url", dashed: bool = False) -> DataFrame:
    """Distinct URLs that lead to chapters, by their path; ``dashed`` also takes paths such as ``/capitulo-12``."""
    u = F.col(url_col)
    leads = u.contains("/capitulo/") | (u.contains("/novelas/") & u.contains("capitulo"))
    return links.where(leads | u.contains("/capitulo-") if dashed else leads).select(url_col).distinct()


def next_pages(pages: DataFrame, config: DataFrame) -> DataFrame:
    """(url, next_url) of pages whose configured next link leads elsewhere."""
    source = dispatch(pages.select("page_id", "url", "html"), config).where("sel_next IS NOT NULL AND html IS NOT NULL").select("url", "html", "sel_next")

    def one(row: dict) -> list[dict]:
        link = _first(parse(row["html"]), row["sel_next"])
        href = link.attrs.get("href", "") if link is not None else ""
        url = urljoin(row["url"], href) if href else ""
        return [{"url": row["url"], "next_url": url}] if url and url != row["url"] else []

    return map_rows(source, one, _NEXT, "url string, next_url string")


def closure(spark: SparkSession, starts: DataFrame, links: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, url, depth): every page reached over next links; a cycle ends where a page would come again.

    Chains are followed to their end, or with ``depth`` over so many links.

    Pointers are doubled, so a chain of n pages takes log2(n) joins instead of n; each round's jumps are written once.
    """
    from ..sources.store import checkpointed

    edges = links.where("url IS NOT NULL AND next_url IS NOT NULL AND url <> next_url").groupBy("url").agg(F.min("next_url").alias("next_url"))
    jump, step = checkpointed(edges.select(F.col("url").alias("a"), F.col("next_url").alias("b"))), 1
    reached = checkpointed(starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("depth")).where("url IS NOT NULL").distinct())
    size = reached.count()
    while depth is None or step <= depth:
        new = reached.join(jump, F.col("url") == F.col("a")).select("start", F.col("b").alias("url"), (F.col("depth") + step).alias("depth"))
        within = reached.unionByName(new) if depth is None else reached.unionByName(new).where(F.col("depth") <= depth)
        reached = checkpointed(within.groupBy("start", "url").agg(F.min("depth").alias("depth")))
        if (now := reached.count()) == size:
            break
        size, left = now, jump.alias("l")
        jump = checkpointed(left.join(jump.alias("r"), F.col("l.b") == F.col("r.a")).select(F.col("l.a"), F.col("r.b")))
        step *= 2
    return reached


def headings(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, tag, level, pos, text) of h1 to h4 of every file, in document order."""
    source = files.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content"))

    def one(row: dict) -> list[dict]:
        if not row["content"]:
            return []
        return [{"id": row["id"], "tag": e.tag, "level": int(e.tag[1]), "pos": k, "text": e.text()} for k, e in enumerate(parse(row["content"]).select("h1, h2, h3, h4"))]

    return map_rows(source, one, _HEADING, "id string, tag string, level int, pos int, text string")
