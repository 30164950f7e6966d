"""A lenient HTML tree and the selectors the site configurations use, on one regular expression per token.

Text, titles, links and headings agree with browser-like parsers; content agrees up to white space.  ``p``, ``li``,
``dt``, ``dd``, ``option``, ``tr``, ``td`` and ``th`` end where a sibling begins, void elements never hold anything,
an end tag without a start is passed over (but for ``</p>``, which stands for an empty paragraph, as in browsers), and
comments stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape, unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl select div section article body html".split())
RAW = frozenset(["script", "style"])


_BLANKS = re.compile("[ \\t\\n\\f\\r\\xa0]+")
_UNSEEN = re.compile("[\\u200b\\xad]")


class Comment(str):
    """A comment's text; it is written again but never read as text."""

    __slots__ = ()


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """The element and all below it in document order."""
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self) -> str:
        """Visible text; runs of blanks, no-break spaces included, are one, blocks are set apart, soft hyphens and zero-width spaces go."""
        parts: list[str] = []
        todo: list[Element | str] = list(reversed(self.children)) if self.tag not in RAW else []
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                if not isinstance(c, Comment):
                    parts.append(c)
            elif c.tag == "br":
                parts.append(" ")
            elif c.tag not in RAW:
                if c.tag in BLOCK or c.tag in CLOSED_BY:
                    parts.append(" ")
                    todo.append(" ")
                todo += reversed(c.children)
        return _BLANKS.sub(" ", _UNSEEN.sub("", "".join(parts))).strip(" ")

    def inner_html(self) -> str:
        out: list[str] = []
        todo: list[tuple[Element | str, bool]] = [(c, self.tag in RAW) for c in reversed(self.children)]
        while todo:
            c, raw = todo.pop()
            if isinstance(c, Comment):
                out.append(f"<!--{c}-->")
                continue
            if isinstance(c, str):
                out.append(c if raw else escape(c, quote=False).replace("\xa0", "&#160;"))
                continue
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items())
            if c.tag in VOID:
                out.append(f"<{c.tag}{attrs} />")
                continue
            out.append(f"<{c.tag}{attrs}>")
            todo.append((f"</{c.tag}>", True))
            todo += [(x, c.tag in RAW) for x in reversed(c.children)]
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def select(self, selector: str) -> list[Element]:
        """Matching elements in document order."""
        test = compiled(selector)
        return [e for e in self.walk() if test(e)]

    def first(self, selector: str) -> Element | None:
        test = compiled(selector)
        return next((e for e in self.walk() if test(e)), None)

    def first_of(self, selectors: tuple[str, ...], accept: Callable[[Element], bool] | None = None) -> tuple[int, Element] | None:
        """(rank, element) of the first selector with an accepted match, and its first match, in one walk."""
        tests = [compiled(x) for x in selectors]
        best: tuple[int, Element] | None = None
        for e in self.walk():
            for k in range(len(tests) if best is None else best[0]):
                if tests[k](e) and (accept is None or accept(e)):
                    best = (k, e)
                    break
            if best is not None and best[0] == 0:
                break
        return best

    def first_with_text(self, text: str) -> Element | None:
        """The first element with exactly this visible text.

        Lengths without blanks are summed from the leaves up, so that only elements of the right length are read.
        """
        want = len("".join(text.split()))
        order = list(self.walk())
        size: dict[int, int] = {}
        for e in reversed(order):
            n = 0
            if e.tag not in RAW:
                for c in e.children:
                    if isinstance(c, Element):
                        n += size[id(c)]
                    elif not isinstance(c, Comment):
                        n += len("".join(_UNSEEN.sub("", c).split()))
            size[id(e)] = n
        return next((e for e in order if size[id(e)] == want and e.text() == text), None)


# A comment, a declaration, or a tag with its attributes; the last form is for quotes that are never closed.
_TOKEN = re.compile(
    r"<!--(?P<note>.*?)-->|<!(?!--)[^>]*>|<\?[^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>", re.DOTALL
)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        name = m.group(1).lower()
        if name not in out:
            value = m.group(2) or m.group(3) or m.group(4) or ""
            out[name] = unescape(value) if "&" in value else value
    return out


def _opened(at: Element, tag: str) -> Element:
    """The element a new tag goes into, after those that it ends."""
    closes = CLOSED_BY.get(tag, frozenset())
    if tag in BLOCK:
        closes = closes | {"p"}
    if closes:
        e = at
        while e.parent is not None and (e.tag in closes or e.tag not in SCOPE):
            if e.tag in closes:
                at = e.parent
            e = e.parent
    return at


def _closed(at: Element, tag: str) -> Element:
    e = at
    while e.parent is not None:
        if e.tag == tag:
            return e.parent
        e = e.parent
    return at


def parse(html: str) -> Element:
    """The tree of a text; the root has no tag of its own."""
    root = at = Element("#root", {}, None)
    pos, last = 0, html.rfind(">")
    while pos <= last and (m := _TOKEN.search(html, pos, last + 1)) is not None:
        if m.start() > pos:
            _append(at, html[pos : m.start()])
        pos = m.end()
        tag = m.group("name") or m.group("name2")
        if tag is None:
            if m.group("note") is not None:
                at.children.append(Comment(m.group("note")))
            continue
        tag = tag.lower()
        if m.group("end") or m.group("end2"):
            below = _closed(at, tag)
            if below is at and tag == "p":
                at.children.append(Element("p", {}, at))
            at = below
            continue
        at = _opened(at, tag)
        attrs = m.group("attrs") or m.group("attrs2")
        new = Element(tag, _attributes(attrs) if attrs else {}, at)
        at.children.append(new)
        if tag in RAW:
            end = _RAW_END[tag].search(html, pos)
            stop = end.start() if end else len(html)
            if stop > pos:
                new.children.append(html[pos:stop])
            pos = stop
            at = new
        elif tag not in VOID:
            at = new
    if pos < len(html):
        _append(at, html[pos:])
    return root


def _append(at: Element, text: str) -> None:
    at.children.append(unescape(text) if "&" in text else text)


_PART = re.compile(r"\s*([>+~])\s*|(\s+)|([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:'([^']*)'|\"([^\"]*)\"|([^\]\s]*)))?\s*\]")


@lru_cache(maxsize=512)
def parse_selector(selector: str) -> tuple[tuple[tuple[str, tuple[tuple, ...]], ...], ...]:
    """Groups of (combinator, tests) steps; a selector outside the subset raises ValueError."""
    out = []
    for group in _split_groups(selector):
        steps: list[tuple[str, list[tuple]]] = [("", [])]
        at = 0
        while at < len(group):
            m = _PART.match(group, at)
            if m is None or m.end() == at:
                raise ValueError(f"selector not understood: {selector}")
            at = m.end()
            comb, space, tag, cls, ident, attr, op = m.group(1), m.group(2), m.group(3), m.group(4), m.group(5), m.group(6), m.group(7)
            if comb or space:
                steps.append((comb or " ", []))
            elif tag:
                if tag != "*":
                    steps[-1][1].append(("tag", tag.lower()))
            elif cls:
                steps[-1][1].append(("class", cls))
            elif ident:
                steps[-1][1].append(("attr", "id", "=", ident))
            else:
                value = next((x for x in m.group(8, 9, 10) if x is not None), "")
                steps[-1][1].append(("attr", attr.lower(), op or "", value))
        if any(c in "+~" for c, _ in steps if c):
            raise ValueError(f"selector not understood: {selector}")
        out.append(tuple((c, tuple(t)) for c, t in steps))
    return tuple(out)


def _split_groups(selector: str) -> list[str]:
    return [g.strip() for g in re.split(r",(?![^\[]*\])", selector) if g.strip()]


_ATTR_TESTS: dict[str, Callable[[str, str], bool]] = {
    "": lambda value, want: True,
    "=": lambda value, want: value == want,
    "*=": lambda value, want: want in value,
    "^=": lambda value, want: value.startswith(want),
    "$=": lambda value, want: value.endswith(want),
    "~=": lambda value, want: want in value.split(),
    "|=": lambda value, want: value == want or value.startswith(want + "-"),
}


def _test(e: Element, test: tuple) -> bool:
    if test[0] == "tag":
        return e.tag == test[1]
    if test[0] == "class":
        return test[1] in e.attrs.get("class", "").split()
    value = e.attrs.get(test[1])
    return value is not None and _ATTR_TESTS[test[2]](value, test[3])


def _matches(e: Element, steps: tuple, k: int) -> bool:
    if e.tag == "#root":
        return False
    for test in steps[k][1]:
        if not _test(e, test):
            return False
    if k == 0:
        return True
    up = e.parent
    if steps[k][0] == ">":
        return up is not None and _matches(up, steps, k - 1)
    while up is not None:
        if _matches(up, steps, k - 1):
            return True
        up = up.parent
    return False


@lru_cache(maxsize=512)
def compiled(selector: str) -> Callable[[Element], bool]:
    """A test of one element; groups that end in a tag are looked up by it."""
    by_tag: dict[str, list[tuple]] = {}
    other: list[tuple] = []
    for group in parse_selector(selector):
        tag = next((t[1] for t in group[-1][1] if t[0] == "tag"), None)
        (other if tag is None else by_tag.setdefault(tag, [])).append(group)

    def test(e: Element) -> bool:
        for group in by_tag.get(e.tag, ()):
            if _matches(e, group, len(group) - 1):
                return True
        for group in other:
            if _matches(e, group, len(group) - 1):
                return True
        return False

    return test
