"""Corpus normalisation: every change is a plan (a DataFrame to look at) and an apply."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..functions.arrow import map_rows
from ..functions.html_tree import Element, parse
from .position import by_order

# Fixed value: where a file's title is sought, the first selector with any element decides.
TITLE_PLACES = ("h1", "h2", "h3", "h4", "p > strong", "p", "b")

_PLACE = pa.schema([("id", pa.string()), ("place", pa.string()), ("tag", pa.string()), ("old_title", pa.string())])
_FILE = pa.schema([("id", pa.string()), ("content", pa.string()), ("changed", pa.bool_())])


_CONTENT = pa.schema([("id", pa.string()), ("content", pa.string())])
_TITLED = pa.schema([*_FILE, ("old_title", pa.string()), ("new_title", pa.string())])
_REPORT = pa.schema([("id", pa.string()), ("tag", pa.string()), ("level", pa.int32()), ("pos", pa.int32()), ("text", pa.string()), ("is_valid", pa.bool_()), ("keep", pa.bool_())])
_HEADING = re.compile("<h[1-4]", re.IGNORECASE)


def _files(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return files.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content"))


def _title_element(root: Element) -> tuple[str, Element] | None:
    found = root.first_of(TITLE_PLACES)
    return None if found is None else (TITLE_PLACES[found[0]], found[1])


def title_places(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, place, tag, old_title): the element that holds each file's title."""

    def one(row: dict) -> list[dict]:
        hit = _title_element(parse(row["content"])) if row["content"] else None
        return [{"id": row["id"], "place": hit[0], "tag": hit[1].tag, "old_title": hit[1].text()}] if hit else []

    return map_rows(_files(files, id_col, content_col), one, _PLACE, "id string, place string, tag string, old_title string")


def title_changes(places: DataFrame) -> DataFrame:
    """Adds new_title and promote; rows are changes only: the text differs, or the tag isn't h1."""
    planned = places.withColumn("new_title", R.standard_title("old_title")).where("new_title IS NOT NULL")
    return planned.withColumn("promote", F.col("tag") != "h1").where((F.col("old_title") != F.col("new_title")) | F.col("promote"))


def _set_title(root: Element, title: str) -> None:
    head = root.first("head")
    element = root.first("title")
    if element is None and head is not None:
        element = Element("title", {}, head)
        head.children.append(element)
    if element is not None:
        element.children[:] = [title]


def _retitle(root: Element, place: str, title: str) -> None:
    old = root.first(place)
    if old is not None:
        if place == "p > strong":
            old = old.parent
        new = Element("h1", {}, old.parent)
        new.children.append(title)
        old.parent.children[old.parent.children.index(old)] = new
    _set_title(root, title)


def standardized(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, content, changed, old_title, new_title): files with their title in standard form, planned and applied in one pass.

    new_title is null where nothing is to be changed.
    """

    def one(row: dict) -> list[dict]:
        out = {"id": row["id"], "content": row["content"], "changed": False, "old_title": None, "new_title": None}
        if row["content"]:
            root = parse(row["content"])
            if (hit := _title_element(root)) is not None:
                old = hit[1].text()
                new = R.standard_title_of(old)
                out["old_title"] = old
                if new is not None and (new != old or hit[1].tag != "h1"):
                    _retitle(root, hit[0], new)
                    content = _document(row["content"], root)
                    out |= {"content": content, "changed": content != row["content"], "new_title": new}
        return [out]

    return map_rows(_files(files, id_col, content_col), one, _TITLED, "id string, content string, changed boolean, old_title string, new_title string")


def rewritten_heads(files: DataFrame, id_col: str, content_col: str, title_col: str) -> DataFrame:
    """(id, content): files whose first ``<h1>`` and ``<title>`` get another text; a null title leaves a file as it is."""
    source = files.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content"), F.col(title_col).alias("title"))

    def one(row: dict) -> list[dict]:
        content = row["content"]
        if row["title"] is not None and content:
            root = parse(content)
            for tag in ("h1", "title"):
                if (e := root.first(tag)) is not None:
                    e.children[:] = [row["title"]]
            content = _document(content, root)
        return [{"id": row["id"], "content": content}]

    return map_rows(source, one, _CONTENT, "id string, content string")


def cleaned(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, content, changed): files of whose headings each level keeps the first valid one, in one pass."""

    def one(row: dict) -> list[dict]:
        out = {"id": row["id"], "content": row["content"], "changed": False}
        if row["content"] and _HEADING.search(row["content"]):
            root = parse(row["content"])
            found = root.select("h1, h2, h3, h4")
            drop = [e for e, keep in zip(found, _kept(found), strict=True) if not keep]
            for e in drop:
                e.remove()
            if drop:
                out |= {"content": _document(row["content"], root), "changed": True}
        return [out]

    return map_rows(_files(files, id_col, content_col), one, _FILE, "id string, content string, changed boolean")


def heading_report(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, tag, level, pos, text, is_valid, keep): the plan of ``cleaned`` in one pass, without a shuffle."""

    def one(row: dict) -> list[dict]:
        if not row["content"] or not _HEADING.search(row["content"]):
            return []
        found = parse(row["content"]).select("h1, h2, h3, h4")
        return [
            {"id": row["id"], "tag": e.tag, "level": int(e.tag[1]), "pos": k, "text": (text := e.text()), "is_valid": R.is_valid_heading(text), "keep": keep} for k, (e, keep) in enumerate(zip(found, _kept(found), strict=True))
        ]

    return map_rows(_files(files, id_col, content_col), one, _REPORT, "id string, tag string, level int, pos int, text string, is_valid boolean, keep boolean")


def _kept(found: list[Element]) -> list[bool]:
    """Whether each heading stays: the first valid one of its level."""
    seen: set[str] = set()
    out = []
    for e in found:
        keep = e.tag not in seen and R.is_valid_heading(e.text())
        if keep:
            seen.add(e.tag)
        out.append(keep)
    return out


def apply_titles(files: DataFrame, changes: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, content, changed): files with the planned titles as their ``<h1>`` and ``<title>``, for plans that somebody has edited."""
    joined = _files(files, id_col, content_col).join(changes.select("id", "place", "new_title"), "id", "left")

    def one(row: dict) -> list[dict]:
        content, title = row["content"], row["new_title"]
        if title is None or not content:
            return [{"id": row["id"], "content": content, "changed": False}]
        root = parse(content)
        _retitle(root, row["place"], title)
        out = _document(content, root)
        return [{"id": row["id"], "content": out, "changed": out != content}]

    return map_rows(joined, one, _FILE, "id string, content string, changed boolean")


def _document(old: str, root: Element) -> str:
    """The tree as text, behind the declarations of the old text."""
    head = re.match(r"\s*(?:<\?xml[^>]*\?>\s*)?(?:<!DOCTYPE[^>]*>\s*)?", old, re.IGNORECASE)
    return (head.group() if head else "") + root.inner_html()


def heading_plan(headings: DataFrame) -> DataFrame:
    """Adds is_valid and keep: of each file and level the first valid heading stays, all others go."""
    valid = headings.withColumn("is_valid", R.valid_heading("text"))
    order = Window.partitionBy("id", "level", "is_valid").orderBy("pos")
    return valid.withColumn("keep", F.col("is_valid") & (F.row_number().over(order) == 1))


def apply_headings(files: DataFrame, plan: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, content, changed): files without the headings that the plan drops, for plans that somebody has edited."""
    drop = plan.where(~F.col("keep")).groupBy("id").agg(F.collect_list("pos").alias("drop"))
    joined = _files(files, id_col, content_col).join(drop, "id", "left")

    def one(row: dict) -> list[dict]:
        if not row["drop"] or not row["content"]:
            return [{"id": row["id"], "content": row["content"], "changed": False}]
        root = parse(row["content"])
        found = root.select("h1, h2, h3, h4")
        for k in row["drop"]:
            if k < len(found):
                found[k].remove()
        return [{"id": row["id"], "content": _document(row["content"], root), "changed": True}]

    return map_rows(joined, one, _FILE, "id string, content string, changed boolean")


def repair(files: DataFrame, content_col: str) -> DataFrame:
    """Adds issues (codes in order), repaired and changed; a string function in the JVM."""
    return files.withColumn("issues", R.markup_issues(content_col)).withColumn("repaired", R.repair_markup(content_col)).withColumn("changed", ~F.col("repaired").eqNullSafe(F.col(content_col)))


def link_css(files: DataFrame, content_col: str, href: str = "../Styles/stylesheet.css") -> DataFrame:
    """Adds linked and changed."""
    return files.withColumn("linked", R.link_stylesheet(content_col, href)).withColumn("changed", ~F.col("linked").eqNullSafe(F.col(content_col)))


def rename_plan(files: DataFrame, book_col: str, name_col: str, tie_col: str) -> DataFrame:
    """Adds new_name: ``CapituloNNNN.xhtml`` by place in the order of names within a book; ``tie_col`` settles equal names."""
    return by_order(files, book_col, [name_col, tie_col], "_pos").withColumn("new_name", R.chapter_file(F.col("_pos") + 1)).drop("_pos")
