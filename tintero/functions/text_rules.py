"""Text rules as Column expressions; everything here stays inside the JVM and code generation."""

from __future__ import annotations

import re
from functools import reduce
from html import unescape
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the text rules.  Letter case is ASCII only, as in java.util.regex.
CHAPTER_MARK = r"(?i)Cap[ií]tulo\s*\d+"
NUMBER_STANDARD = r"(?i)(?:Cap[íi]tulo|Ch\.|Vol\.|Episodio)\s*(\d+)"
NUMBER_INITIALS = r"^[A-Za-z]{2,5}\s+(\d+)"
NUMBER_ANY = r"(\d+)"
NUMBER_IN_URL = r"(?i)cap[ií]tulo[-_\s]*?(\d+)"
TITLE_NAMED = r"(?i)\A.*Cap[ií]tulo\s*(\d+)[\s:\u2013—.-]?\s*(.*)\z"
TITLE_NUMBERED = r"\A(\d+)[\s:\u2013—.-]+\s*([^<]+.*)\z"
FILE_NUMBER = r"(?i)(?:Capitulo|Cap|Chapter|Ch)(\d+)\.xhtml"
VALID_HEADING = r"(?i)^Cap[ií]tulo\s+\d+.*\w.*"
OPEN_LINK = r"(?i)<link[^>]+(?<!/)>"
ANY_HR = r"(?i)<hr[^>]*/?>"
OPEN_IMG = r"(?i)<img(?:\"[^\"]*\"|'[^']*'|[^'\">])*?(?<!/)\s*>"
OPEN_BR = r"(?i)<br>(?!</br>|</br>|\s*/>)"
UNTITLED = "(Título no encontrado)"
XML_DECLARATION = '<?xml version="1.0" encoding="utf-8"?>'
XHTML = "application/xhtml+xml"
NO_AUTHOR, NO_SYNOPSIS, NO_GENRES = "Desconocido", "No disponible.", "No especificados."
# Seconds per chapter by number of threads: (most threads, seconds); beyond the last 5.5.
THREAD_SECONDS = ((2, 2.0), (5, 2.2), (6, 2.8), (7, 3.5), (8, 4.2), (9, 4.9))
BEYOND_SECONDS = 5.5
# Issue codes in the order in which they are reported.
ISSUES = ("nbsp", "markdown", "xml_declaration", "link", "hr", "img", "br")


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(as_col(text), pattern, group), F.lit(""))


def as_int(digits: Column) -> Column:
    """INT, or null where the digits don't fit."""
    return digits.try_cast("int")


def java_trim(text: Column | str) -> Column:
    """Strips everything up to U+0020 at both ends."""
    return F.regexp_replace(as_col(text), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def collapse(text: Column | str) -> Column:
    """Blanks, no-break spaces included, as single ones and none at the ends; soft hyphens and zero-width spaces go."""
    return F.trim(F.regexp_replace(F.regexp_replace(as_col(text), r"[\x{200b}\x{ad}]", ""), r"[ \t\n\f\r\x{a0}]+", " "))


def number_from_text(text: Column | str) -> Column:
    """Chapter number of a label: the first of three rules that matches decides; null if it doesn't fit an INT."""
    return as_int(F.coalesce(found(text, NUMBER_STANDARD), found(text, NUMBER_INITIALS), found(text, NUMBER_ANY)))


def number_from_url(url: Column | str) -> Column:
    """Chapter number of a URL: after the chapter word, else the first digits."""
    return as_int(F.coalesce(found(url, NUMBER_IN_URL), found(url, NUMBER_ANY)))


def chapter_number(text: Column | str, url: Column | str) -> tuple[Column, Column]:
    """(number, source): of the label, or of the URL where the label has no positive number; null if neither has.

    A label whose number overflows is rejected outright.
    """
    digits = F.coalesce(found(text, NUMBER_STANDARD), found(text, NUMBER_INITIALS), found(text, NUMBER_ANY))
    label, fallback = as_int(digits), number_from_url(url)
    number = F.when(label > 0, label).when(digits.isNotNull() & label.isNull(), F.lit(None).cast("int")).otherwise(F.when(fallback > 0, fallback))
    return number, F.when(number.isNull(), F.lit(None).cast("string")).when(label > 0, F.lit("text")).otherwise(F.lit("url"))


def mend_apostrophe(text: Column | str) -> Column:
    """U+FFFD stands for a lost typographic apostrophe."""
    return F.replace(as_col(text), F.lit("\ufffd"), F.lit("\u2019"))


def standard_title(text: Column | str) -> Column:
    """``Capítulo N: name``, or null where the text isn't a chapter title."""
    t = java_trim(mend_apostrophe(text))
    named = F.regexp_like(t, F.lit(TITLE_NAMED))
    numbered = F.regexp_like(t, F.lit(TITLE_NUMBERED))

    def title(pattern: str) -> Column:
        name = java_trim(F.regexp_extract(t, pattern, 2))
        return F.concat(F.lit("Capítulo "), F.regexp_extract(t, pattern, 1), F.lit(": "), F.when(name == "", F.lit(UNTITLED)).otherwise(name))

    return F.when(named, title(TITLE_NAMED)).when(numbered, title(TITLE_NUMBERED))


def named_title(text: Column | str) -> Column:
    """``Capítulo N: name`` of a text that has the chapter word, else null: the rule for the headings of books."""
    t = mend_apostrophe(java_trim(text))
    name = java_trim(F.regexp_extract(t, TITLE_NAMED, 2))
    return F.when(F.regexp_like(t, F.lit(TITLE_NAMED)), F.concat(F.lit("Capítulo "), F.regexp_extract(t, TITLE_NAMED, 1), F.lit(": "), F.when(name == "", F.lit(UNTITLED)).otherwise(name)))


# The same rules on single strings, for work that has a file's tree in hand.
_NAMED, _NUMBERED, _VALID = (re.compile(p.replace(r"\z", r"\Z"), re.ASCII) for p in (TITLE_NAMED, TITLE_NUMBERED, VALID_HEADING))
_TRIMMED = "".join(map(chr, range(33)))


def standard_title_of(text: str) -> str | None:
    t = text.replace("\ufffd", "\u2019").strip(_TRIMMED)
    m = _NAMED.match(t) or _NUMBERED.match(t)
    return f"Capítulo {m.group(1)}: {m.group(2).strip(_TRIMMED) or UNTITLED}" if m else None


def is_valid_heading(text: str) -> bool:
    return _VALID.search(text) is not None


def valid_heading(text: Column | str) -> Column:
    return F.coalesce(F.regexp_like(as_col(text), F.lit(VALID_HEADING)), F.lit(False))


def file_number(name: Column | str) -> Column:
    """First digits of a file name."""
    return as_int(found(name, NUMBER_ANY))


def href_number(href: Column | str) -> Column:
    """Chapter number of a section's file name."""
    return as_int(found(href, FILE_NUMBER))


def title_digits(title: Column | str) -> Column:
    """First digits of a title, 0 without any."""
    return F.coalesce(file_number(title), F.lit(0))


def chapter_file(number: Column | str) -> Column:
    return F.format_string("Capitulo%04d.xhtml", as_col(number))


def stem(name: Column | str) -> Column:
    """Name without a final ``.epub`` in any case."""
    return F.regexp_replace(as_col(name), r"(?i)\.epub$", "")


def html_escape(text: Column | str) -> Column:
    t = F.replace(as_col(text), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def url_quote(text: Column | str) -> Column:
    """Percent-encoded UTF-8 with blanks as %20."""
    return F.replace(F.url_encode(as_col(text)), F.lit("+"), F.lit("%20"))


def decoded(text: Column | str) -> Column:
    """The text with its character references decoded: the named ones of HTML 4, decimal and hexadecimal ones.

    Numbers from 128 to 159 mean the characters of Windows-1252, as in browsers.
    """
    t = as_col(text)
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])
    windows = F.create_map(*[F.lit(x) for code in range(128, 160) for x in (f"{code:X}", unescape(f"&#{code};"))])
    parts = F.split(t, "&", -1)

    def one(part: Column) -> Column:
        def number(pattern: str, base: int) -> Column:
            code = F.conv(found(part, pattern), base, 16)
            return F.when(code.isNotNull() & (F.length(code) <= 6), F.coalesce(F.try_element_at(windows, F.ltrim(code, F.lit("0"))), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")))

        meant = F.coalesce(F.try_element_at(names, found(part, "^([A-Za-z]+[0-9]*);")), number("^#([0-9]{1,7});", 10), number("^#[xX]([0-9A-Fa-f]{1,6});", 16))
        return F.coalesce(F.concat(meant, F.regexp_replace(part, "^[^;]*;", "")), F.concat(F.lit("&"), part))

    rest = F.transform(F.slice(parts, 2, F.size(parts)), one)
    return F.when(t.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(t)


def tag_text(html: Column | str, tag: str) -> Column:
    """Text of the first element of a tag in regular markup, references decoded; null if there is none."""
    # the element as a whole, so one scan tells whether it is there as well; its own tags go with those inside
    whole = found(html, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", 0)
    return collapse(decoded(F.regexp_replace(whole, "<[^>]*>", "")))


# Without a match of this no tag rule applies; one scan instead of one per rule.
_RULED_TAG = r"(?i)<(?:link|hr|img|br>|/?markdown)"


def _codes(c: Column, tags: bool) -> Column:
    tests = [c.contains("&nbsp;"), c.contains("markdown"), ~F.regexp_like(c, F.lit(r"\A[\x00-\x20]*<\?xml"))]
    if tags:
        tests += [F.regexp_like(c, F.lit(p)) for p in (OPEN_LINK, ANY_HR, OPEN_IMG, OPEN_BR)]
    return F.array_compact(F.array(*[F.when(t, F.lit(code)) for t, code in zip(tests, ISSUES, strict=False)]))


def markup_issues(content: Column | str) -> Column:
    """Codes of the defects of one file, in order; an array without any is empty, that of null is null."""
    c = as_col(content)
    return F.when(F.regexp_like(c, F.lit(_RULED_TAG)), _codes(c, True)).when(c.isNotNull(), _codes(c, False))


def repair_markup(content: Column | str) -> Column:
    """A file with any issue gets every repair; others stay as they are."""
    c = as_col(content)
    declared = F.when(F.regexp_like(c, F.lit(r"\A[\x00-\x20]*<\?xml")), c).otherwise(F.concat(F.lit(XML_DECLARATION + "\n"), c))
    plain = F.replace(declared, F.lit("&nbsp;"), F.lit("&#160;"))
    steps = (
        (r"(?i)(<link[^>]+)(?<!/)>", "$1 />"), (ANY_HR, ""), (r"(?i)(<img(?:\"[^\"]*\"|'[^']*'|[^'\">])*?)(\s*)(?<!/)>", "$1$2/>"), (r"(?i)<markdown[^>]*>", ""), (r"(?i)</markdown>", ""), (r"(?i)<br>", "<br />"),
    )
    full = reduce(lambda x, step: F.regexp_replace(x, step[0], step[1]), steps, plain)
    tagged = F.when(F.size(_codes(c, True)) > 0, full).otherwise(c)
    return F.when(F.regexp_like(c, F.lit(_RULED_TAG)), tagged).otherwise(F.when(F.size(_codes(c, False)) > 0, plain).otherwise(c))


def link_stylesheet(content: Column | str, href: str = "../Styles/stylesheet.css") -> Column:
    """Adds the stylesheet at the end of the head unless it is linked already; without a head nothing changes."""
    c = as_col(content)
    link = f'<link rel="stylesheet" type="text/css" href="{href}" />'
    return F.when(c.contains(f'href="{href}"'), c).otherwise(F.regexp_replace(c, "(?i)</head>", f"{link}</head>"))


def media_type(name: Column | str) -> Column:
    """Media type by a file name's extension."""
    ext = F.lower(F.element_at(F.split(as_col(name), r"\."), -1))
    kinds = {
        "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml", "css": "text/css", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
        "gif": "image/gif", "svg": "image/svg+xml", "ttf": "application/x-truetype-font", "otf": "application/vnd.ms-opentype", "woff": "application/font-woff", "ncx": "application/x-dtbncx+xml",
    }
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in kinds.items():
        out = out.when(ext == k, F.lit(v))
    return out.otherwise(F.lit("application/octet-stream"))


def or_default(text: Column | str, default: str) -> Column:
    """The text, or the default where it is null or blank."""
    t = as_col(text)
    return F.when(t.isNull() | (F.trim(F.regexp_replace(t, r"\s+", " ")) == ""), F.lit(default)).otherwise(t)


def subjects_of(text: Column | str) -> Column:
    """Comma-separated subjects, each trimmed; null for an empty text."""
    t = as_col(text)
    return F.when(t != "", F.transform(F.split(t, ",", -1), java_trim))


def thread_seconds(threads: Column | str) -> Column:
    t = as_col(threads)
    out = F.when(F.lit(False), F.lit(0.0))
    for most, seconds in THREAD_SECONDS:
        out = out.when(t <= most, F.lit(seconds))
    return out.otherwise(F.lit(BEYOND_SECONDS))


def download_seconds(chapters: Column | str, threads: Column | str) -> Column:
    """Estimated wall time of fetching some chapters with some threads."""
    return as_col(chapters) * thread_seconds(threads) / as_col(threads)


def minutes_seconds(millis: Column | str) -> tuple[Column, Column]:
    s = F.floor(as_col(millis) / 1000)
    return F.floor(s / 60), s % 60
