"""Book algebra: split plans, page insertion, tables of contents, metadata and page templates as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..sources.store import checkpointed
from .position import by_number, by_order

# The generated pages.
XHTML_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN"\n  "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">\n'
    '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="es">\n<head>\n'
)
STYLE_LINK = '  <link rel="stylesheet" type="text/css" href="../Styles/stylesheet.css" />\n'
INFO_STYLE = "body { font-family: sans-serif; margin: 2em; } h1 { text-align: center; } h2 { border-bottom: 1px solid #ccc; padding-bottom: 0.2em; } dt { font-weight: bold; margin-top: 0.5em; } dd { margin-left: 0; margin-bottom: 0.5em; }"
START_STYLE = (
    "body { font-family: sans-serif; margin: 2em; text-align: center; } h1 { font-size: 2.5em; margin-top: 3em; } h2 { font-size: 1.8em; font-weight: normal; margin-top: 1em; } "
    "dl { margin-top: 4em; display: inline-block; text-align: left; } dt { font-weight: bold; } dd { margin-left: 0; margin-bottom: 1em; }"
)
TOC_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="es">\n<head>\n    <meta charset="UTF-8"/>\n'
    '    <title>Tabla de Contenidos</title>\n    <link rel="stylesheet" type="text/css" href="../Styles/stylesheet.css"/>\n</head>\n<body>\n    <nav epub:type="toc" id="toc">\n        <h1>Índice</h1>\n        <ol>\n'
)
TOC_TAIL = "        </ol>\n    </nav>\n</body>\n</html>"
PLAIN_TOC_HEAD = '<!DOCTYPE html><html><head><title>TOC</title></head><body><h1>Índice</h1><nav epub:type="toc"><ol>\n'
PLAIN_TOC_TAIL = "</ol></nav></body></html>"
SYNOPSIS_HEAD = "<?xml version='1.0' encoding='utf-8'?>\n<html xmlns=\"http://www.w3.org/1999/xhtml\">\n<head><title>Sinopsis</title>\n"
NO_TITLE = "Libro sin Título"
STRETCH = 50  # places of a book that are looked up together


# Splits


def ordered_spine(spine: DataFrame, book: str = "book_id", idx: str = "spine_idx") -> DataFrame:
    """Adds pos: the section's place from 0 within its book, whatever holes its index has."""
    return by_number(spine, book, idx)


def _sizes(spine: DataFrame, book: str) -> DataFrame:
    return spine.groupBy(book).agg(F.count(F.lit(1)).alias("n"))


def _parts(plan: DataFrame, book: str) -> DataFrame:
    """(book, part, total_parts, start_idx, end_idx) of equal slices of ``size`` sections, ``total`` as titles say it."""
    n_parts = F.ceil(F.col("n") / F.col("size"))
    rows = plan.withColumn("part", F.explode(F.sequence(F.lit(1), n_parts.cast("int"))))
    return rows.select(
        book, "part", F.col("total").cast("int").alias("total_parts"), ((F.col("part") - 1) * F.col("size")).cast("int").alias("start_idx"),
        (F.least(F.col("part") * F.col("size"), F.col("n")) - 1).cast("int").alias("end_idx"),
    )


def split_in_parts(spine: DataFrame, parts: int, book: str = "book_id") -> DataFrame:
    """At most ``parts`` slices of ceil(n / parts) sections; fewer if they run out, while titles keep the number asked for.

    Books with fewer sections than parts are rejected (no rows), as are parts below 1 (error).
    """
    if parts < 1:
        raise ValueError("a book is split into at least one part")
    size = F.ceil(F.col("n") / F.lit(parts))
    return _parts(_sizes(spine, book).where(F.col("n") >= parts).select(book, "n", size.alias("size"), F.lit(parts).alias("total")), book)


def split_in_chunks(spine: DataFrame, chunk: int, book: str = "book_id") -> DataFrame:
    """Slices of ``chunk`` sections each."""
    if chunk < 1:
        raise ValueError("a chunk has at least one section")
    n = F.col("n")
    return _parts(_sizes(spine, book).select(book, "n", F.lit(chunk).alias("size"), F.ceil(n / chunk).alias("total")), book)


def split_range(spine: DataFrame, first: int, last: int, book: str = "book_id") -> DataFrame:
    """One slice from the ``first`` to the ``last`` section, counted from 1; books where that isn't 1 <= a <= b <= n are rejected."""
    fits = _sizes(spine, book).where((F.lit(first) >= 1) & (F.lit(first) <= F.lit(last)) & (F.lit(last) <= F.col("n")))
    return fits.select(book, F.lit(1).alias("part"), F.lit(1).alias("total_parts"), F.lit(first - 1).alias("start_idx"), F.lit(last - 1).alias("end_idx"))


def chapter_map(spine: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, chapter_no, spine_idx): the last section of each chapter number that file names give."""
    numbered = spine.withColumn("chapter_no", R.href_number("href")).where("chapter_no IS NOT NULL")
    return numbered.groupBy(book, "chapter_no").agg(F.max("spine_idx").alias("spine_idx"))


def split_custom(chapters: DataFrame, ends: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, part, first_chapter, last_chapter, start_idx, end_idx): parts that end at requested chapter numbers.

    ``chapters`` is a chapter map and ``ends`` (book, end_no) the ascending requests, which somebody typed and which
    therefore fit an array.  A part holds the existing chapters after the last request's up to its own; empty parts are
    dropped and the rest numbered on.  Each chapter looks its request up in its book's array.
    """
    wanted = ends.where("end_no IS NOT NULL").groupBy(book).agg(F.sort_array(F.collect_set("end_no")).alias("ends"))
    placed = chapters.join(wanted, book).withColumn("end_no", F.try_element_at(F.filter("ends", lambda e: e >= F.col("chapter_no")), F.lit(1))).where("end_no IS NOT NULL")
    parts = placed.groupBy(book, "end_no").agg(
        F.min("chapter_no").alias("first_chapter"), F.max("chapter_no").alias("last_chapter"), F.min_by("spine_idx", "chapter_no").alias("start_idx"), F.max_by("spine_idx", "chapter_no").alias("end_idx")
    )
    number = F.row_number().over(Window.partitionBy(book).orderBy("end_no"))
    return parts.select(book, number.alias("part"), "first_chapter", "last_chapter", "start_idx", "end_idx")


def next_existing(requests: DataFrame, chapters: DataFrame, book: str = "book_id", at: str = "chapter_no") -> DataFrame:
    """(book, at, next_no, prev_no): for each asked number the first existing one at or after it and the last at or before it.

    Existing numbers are reduced to the least and greatest between neighbouring requests first; only as many rows as
    there are requests are then ordered.
    """
    asked = requests.select(book, F.col(at).alias("n")).where("n IS NOT NULL").distinct()
    arrays = asked.groupBy(book).agg(F.sort_array(F.collect_list("n")).alias("asks"))
    have = chapters.select(book, F.col("chapter_no").alias("c")).join(arrays, book)
    above = have.select(book, F.try_element_at(F.filter("asks", lambda a: a <= F.col("c")), F.lit(-1)).alias("n"), "c").where("n IS NOT NULL").groupBy(book, "n").agg(F.min("c").alias("lo"))
    below = have.select(book, F.try_element_at(F.filter("asks", lambda a: a >= F.col("c")), F.lit(1)).alias("n"), "c").where("n IS NOT NULL").groupBy(book, "n").agg(F.max("c").alias("hi"))
    down = Window.partitionBy(book).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(book).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.join(above, [book, "n"], "left").join(below, [book, "n"], "left")
    return both.select(book, F.col("n").alias(at), F.min("lo").over(down).alias("next_no"), F.max("hi").over(up).alias("prev_no"))


def split_plan(spine: DataFrame, mode: str, book: str = "book_id", **options: object) -> DataFrame:
    """The four ways of splitting a book: range (first, last), parts (parts), chunks (chunk), custom (ends)."""
    if mode == "range":
        return split_range(spine, int(options["first"]), int(options["last"]), book)  # type: ignore[call-overload]
    if mode == "parts":
        return split_in_parts(spine, int(options["parts"]), book)  # type: ignore[call-overload]
    if mode == "chunks":
        return split_in_chunks(spine, int(options["chunk"]), book)  # type: ignore[call-overload]
    if mode == "custom":
        return split_custom(chapter_map(spine, book), options["ends"], book)  # type: ignore[arg-type]
    raise ValueError(f"no such mode: {mode}")


def sections_of_parts(spine: DataFrame, plan: DataFrame, book: str = "book_id") -> DataFrame:
    """Sections with the part they belong to; ``plan`` has one book's parts as position ranges, which don't overlap.

    A part meets the sections of each stretch of ``STRETCH`` places that it touches, so the join is one of equal keys, a
    section sees only the parts of its stretch, and a book of any size is spread.
    """
    reach = F.sequence(F.floor(F.col("start_idx") / STRETCH), F.floor(F.col("end_idx") / STRETCH))
    parts = plan.where("start_idx <= end_idx").select(F.col(book).alias("_book"), "part", "total_parts", "start_idx", "end_idx", F.explode(reach).alias("_at"))
    placed = ordered_spine(spine, book)
    within = (F.col(book) == F.col("_book")) & (F.floor(F.col("pos") / STRETCH) == F.col("_at")) & F.col("pos").between(F.col("start_idx"), F.col("end_idx"))
    return placed.join(parts, within).select(book, "spine_idx", "href", "pos", "part", "total_parts")


def part_title(title: Column, part: Column, total: Column) -> Column:
    return F.concat(R.or_default(title, NO_TITLE), F.lit(" (Parte "), part.cast("string"), F.lit(" de "), total.cast("string"), F.lit(")"))


def part_names(plan: DataFrame, base: Column | str) -> DataFrame:
    """Adds out_name: the file of each part, from the book's file name without its ending."""
    name = R.stem(base)
    return plan.withColumn("out_name", F.concat(name, F.format_string("_Parte%02d.epub", F.col("part"))))


def batches(index: DataFrame, threads: int = 5, order: str = "chapter_no") -> DataFrame:
    """Adds batch: contiguous batches of ceil(total / threads) chapters of each index; a plan, not how Spark works."""
    sizes = index.groupBy("index_url").agg(F.ceil(F.count(F.lit(1)) / F.lit(threads)).alias("_size"))
    return by_number(index, "index_url", order, "_pos").join(sizes, "index_url").withColumn("batch", F.floor(F.col("_pos") / F.col("_size")).cast("int")).drop("_pos", "_size")


# Insertion and resources


def insert_pages(spine: DataFrame, requests: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, new_idx, href, kind): the reading order with start pages after the requested chapters.

    ``requests`` has (book, req_ord, name, after_chapter); those for unknown chapters are dropped.  Pages after the same
    chapter stand in the order of the requests, and pages are numbered through a book.
    """
    pages = page_targets(spine, requests, book)
    targets = pages.groupBy(book).agg(F.sort_array(F.collect_list("spine_idx")).alias("targets"))
    placed = ordered_spine(spine, book).join(targets, book, "left")
    before = F.coalesce(F.size(F.filter("targets", lambda t: t < F.col("spine_idx"))), F.lit(0))
    own = placed.select(book, (F.col("pos") + F.when(F.col("targets").isNull(), 0).otherwise(before)).alias("new_idx"), "href", F.lit("section").alias("kind"))
    at = placed.select(book, "spine_idx", "pos").join(pages.select(book, "spine_idx", "k", F.col("href").alias("page")), [book, "spine_idx"])
    return own.unionByName(at.select(book, (F.col("pos") + F.col("k")).alias("new_idx"), F.col("page").alias("href"), F.lit("page").alias("kind")))


def insert_toc_entries(toc: DataFrame, pages: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, pos, title, href): top-level contents with entries for inserted pages (book, k, spine_idx, href).

    A page's entry follows the place of its section, or the last entry where the contents are shorter.  Entries move by
    the pages before them, which somebody asked for and which therefore fit an array.
    """
    own = by_order(toc.where("parent_id IS NULL").select(book, "pos", "title", "href"), book, ["pos", "href"], "i")
    size = own.groupBy(book).agg(F.count(F.lit(1)).cast("int").alias("size"))
    after = pages.join(size, book).select(book, F.least(F.col("spine_idx"), F.col("size") - 1).alias("i"), "k", "href")
    nth = F.row_number().over(Window.partitionBy(book).orderBy("i", "k"))
    new = after.select(book, (F.greatest(F.col("i"), F.lit(-1)) + nth).alias("pos"), F.concat(F.lit("Libro "), F.col("k").cast("string")).alias("title"), "href")
    targets = after.groupBy(book).agg(F.sort_array(F.collect_list("i")).alias("targets"))
    before = F.coalesce(F.size(F.filter("targets", lambda t: t < F.col("i"))), F.lit(0))
    placed = own.join(targets, book, "left")
    return placed.select(book, (F.col("i") + F.when(F.col("targets").isNull(), 0).otherwise(before)).alias("pos"), "title", "href").unionByName(new)


def page_targets(spine: DataFrame, requests: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, k, spine_idx, name, href): requested start pages in order, those for unknown chapters left out."""
    at = chapter_map(spine, book)
    target = requests.join(at, (requests[book] == at[book]) & (requests["after_chapter"] == at["chapter_no"])).select(requests[book], "req_ord", "name", "spine_idx")
    k = F.row_number().over(Window.partitionBy(book).orderBy("spine_idx", "req_ord"))
    return target.select(book, k.alias("k"), "spine_idx", "name", F.format_string("info_libro_%d.xhtml", k).alias("href"))


def shared_resources(resources: DataFrame, spine: DataFrame, plan: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, part, href): resources outside the reading order and other than the cover, for every part of their book.

    Only references multiply; the bytes are joined at the sink.
    """
    shared = resources.where(~F.coalesce(F.col("is_cover"), F.lit(False))).select(book, "href").distinct().join(spine.select(book, "href"), [book, "href"], "left_anti")
    return shared.join(plan.select(book, "part"), book).select(book, "part", "href")


def with_cover(resources: DataFrame, covers: DataFrame, book: str = "book_id") -> DataFrame:
    """Resources with is_cover set by ``covers`` (book, name): the file ``Images/<name>``; books without a row keep theirs."""
    named = covers.select(book, F.concat(F.lit("Images/"), "name").alias("cover_href")).dropDuplicates([book])
    joined = resources.join(named, book, "left")
    return joined.withColumn("is_cover", F.when(F.col("cover_href").isNull(), F.coalesce("is_cover", F.lit(False))).otherwise(F.col("href") == F.col("cover_href"))).drop("cover_href")


def updated_cover(resources: DataFrame, book_id: str, href: str) -> DataFrame:
    """Resources of one book with another cover, whose media type follows its ending in any case."""
    mine = F.col("book_id") == book_id
    return resources.withColumn("is_cover", F.when(mine, F.col("href") == href).otherwise(F.col("is_cover"))).withColumn("media_type", F.when(mine & (F.col("href") == href), R.media_type("href")).otherwise(F.col("media_type")))


def toc_titles(spark: SparkSession, toc: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, href, title): the first title of each file in depth-first order of the contents' tree.

    Levels are walked from the roots by a join each, written once, so neither rows nor levels are limited; an entry that
    would come again below itself ends its branch.  Each node carries its path of positions and entries.
    """
    nodes = checkpointed(toc.select(F.col(book).alias("book"), "toc_id", "parent_id", "pos", "title", "href"))
    step = F.struct("pos", "toc_id")
    level = nodes.where("parent_id IS NULL").select("book", "toc_id", "title", "href", F.array(step).alias("path"))
    below = nodes.where("parent_id IS NOT NULL").select(F.col("book").alias("_book"), "parent_id", F.col("toc_id").alias("_id"), F.col("title").alias("_title"), F.col("href").alias("_href"), step.alias("_step"))
    walked = level
    while True:
        deeper = level.join(below, (F.col("book") == F.col("_book")) & (F.col("toc_id") == F.col("parent_id"))).where(~F.exists("path", lambda x: x["toc_id"] == F.col("_id")))
        level = checkpointed(deeper.select("book", F.col("_id").alias("toc_id"), F.col("_title").alias("title"), F.col("_href").alias("href"), F.array_append("path", F.col("_step")).alias("path")))
        if level.isEmpty():
            break
        walked = walked.unionByName(level)
    return walked.where("href IS NOT NULL").groupBy("book", "href").agg(F.min_by("title", "path").alias("title")).withColumnRenamed("book", book)


def heading_changes(files: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, href, old_title, new_title) of the sections of a book whose headings are to be put in standard form.

    ``files`` (book_id, href, media_type, content) are its resources and ``toc`` its contents: only XHTML resources that
    a top-level entry names count, and only if they have a ``<title>`` and an ``<h1>`` with text.
    """
    top = toc.where("parent_id IS NULL").select("book_id", "href").distinct()
    read = files.where(F.col("media_type") == R.XHTML).join(top, ["book_id", "href"], "left_semi").select("book_id", "href", R.tag_text("content", "h1").alias("old_title"), R.tag_text("content", "title").alias("title"))
    planned = read.where("old_title <> '' AND title IS NOT NULL").withColumn("new_title", R.named_title("old_title"))
    return planned.where((F.col("new_title") != F.col("old_title")) | (F.col("new_title") != F.col("title"))).select("book_id", "href", "old_title", "new_title")


def section_titles(spine: DataFrame, titles: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, spine_idx, href, title): each section's title, or its file where the contents lack it."""
    return spine.select(book, "spine_idx", "href").join(titles, [book, "href"], "left").select(book, "spine_idx", "href", F.coalesce("title", "href").alias("title"))


# Contents and pages


def toc_rows(files: DataFrame, book: str, name_col: str, h1_col: str) -> DataFrame:
    """(book, ord, href, label): entries of a generated table of contents, which doesn't list itself."""
    own = files.where(F.lower(name_col) != "toc.xhtml")
    label = R.html_escape(F.coalesce(F.col(h1_col), F.replace(F.col(name_col), F.lit(".xhtml"), F.lit(""))))
    return by_order(own.select(book, name_col, h1_col), book, [name_col, h1_col], costly=True).select(book, (F.col("pos") + 1).alias("ord"), R.url_quote(name_col).alias("href"), label.alias("label"))


def plain_toc_page(files: DataFrame, book: str, name_col: str, h1_col: str) -> DataFrame:
    """(book, html): the older table of contents: every file by name, unescaped, with its whole name where it has no heading."""
    item = F.concat(F.lit('<li><a href="'), F.col(name_col), F.lit('">'), F.coalesce(F.col(h1_col), F.col(name_col)), F.lit("</a></li>\n"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name_col).alias("n"), item.alias("item")))), lambda x: x["item"]), "")
    return files.groupBy(book).agg(F.concat(F.lit(PLAIN_TOC_HEAD), items, F.lit(PLAIN_TOC_TAIL)).alias("html"))


def synopsis_page(synopsis: Column, genres: Column, style: str | None = None) -> Column:
    """The page that opens an older book: its synopsis with line ends kept, and its genres."""
    link = f'<link rel="stylesheet" type="text/css" href="{style}" />\n' if style else ""
    return F.concat(F.lit(SYNOPSIS_HEAD + link + "</head>\n<body>\n <h1>Sinopsis</h1>\n <p>"), F.replace(synopsis, F.lit("\n"), F.lit("<br/>")), F.lit("</p>\n <h2>Géneros</h2>\n <p>"), F.coalesce(genres, F.lit("")), F.lit("</p>\n</body>\n</html>"))


def toc_pages(rows: DataFrame, book: str) -> DataFrame:
    """(book, html): the table of contents of each book."""
    item = F.concat(F.lit('            <li><a href="'), F.col("href"), F.lit('">'), F.col("label"), F.lit("</a></li>\n"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]), "")
    return rows.groupBy(book).agg(F.concat(F.lit(TOC_HEAD), items, F.lit(TOC_TAIL)).alias("html"))


def chapter_page(title: Column | str, content: Column | str) -> Column:
    """XHTML of one chapter; its title is escaped."""
    t, c = R.html_escape(title), R.as_col(content)
    return F.concat(F.lit(XHTML_HEAD + "  <title>"), t, F.lit("</title>\n" + STYLE_LINK + "</head>\n<body>\n  <h1>"), t, F.lit("</h1>\n"), c, F.lit("\n</body>\n</html>"))


def _entry(term: str, value: Column) -> Column:
    return F.concat(F.lit(f"    <dt>{term}</dt>\n    <dd>"), value, F.lit("</dd>\n"))


def _optional(term: str, value: Column | str | None) -> Column:
    v = F.lit(None).cast("string") if value is None else R.as_col(value)
    return F.when(v.isNull() | (F.trim(F.regexp_replace(v, r"\s+", " ")) == ""), F.lit("")).otherwise(_entry(term, R.html_escape(v)))


def info_page(title: Column, author: Column, genres: Column, synopsis: Column, first: Column, last: Column, total: Column | None = None, site: Column | str | None = None, creator: Column | str | None = None) -> Column:
    """The information page of a built book (with ``total``) or of one part of it (without)."""
    span = F.concat(first.cast("string"), F.lit(" - "), last.cast("string"))
    if total is not None:
        span = F.concat(span, F.lit(" (Total: "), total.cast("string"), F.lit(")"))
    named = F.lit("") if total is not None else F.lit("    <dt>Nombre del Libro #:</dt>\n")
    return F.concat(
        F.lit(XHTML_HEAD + "  <title>Información del Libro</title>\n" + STYLE_LINK + f'  <style type="text/css">{INFO_STYLE}</style>\n</head>\n<body>\n  <h1>'),
        R.html_escape(F.coalesce(title, F.lit("Libro"))), F.lit("</h1>\n  <hr/>\n  <h2>Ficha Informativa</h2>\n  <dl>\n"), named, _entry("Capítulos Incluidos:", span),
        F.lit("  </dl>\n  <h2>Información General</h2>\n  <dl>\n"), _entry("Título Original:", R.html_escape(F.coalesce(title, F.lit("No disponible")))),
        _entry("Autor:", R.html_escape(R.or_default(author, R.NO_AUTHOR))), _entry("Géneros:", R.html_escape(R.or_default(genres, R.NO_GENRES))),
        _entry("Sinopsis:", R.html_escape(R.or_default(synopsis, R.NO_SYNOPSIS))), _optional("Sitio de Extracción:", site), _optional("Archivo generado por:", creator),
        F.lit("  </dl>\n</body>\n</html>"),
    )


def start_page(name: Column, number: Column, site: Column | str | None = None, creator: Column | str | None = None) -> Column:
    """The page that opens a book within a volume."""
    n = R.html_escape(name)
    return F.concat(
        F.lit(XHTML_HEAD + "  <title>"), n, F.lit("</title>\n" + STYLE_LINK + f'  <style type="text/css">{START_STYLE}</style>\n</head>\n<body>\n  <h1>Libro '), number.cast("string"),
        F.lit("</h1>\n  <h2>"), n, F.lit("</h2>\n  <hr/>\n  <dl>\n"), _optional("Sitio de Extracción:", site), _optional("Archivo generado por:", creator), F.lit("  </dl>\n</body>\n</html>"),
    )


# Metadata


def metadata_fields(metadata: DataFrame) -> DataFrame:
    """(book_id, title, author, genres, synopsis): first title, first author's names, joined subjects, first description, or defaults."""
    author = F.try_element_at("authors", F.lit(1))
    name = F.when(author.isNull(), F.lit(R.NO_AUTHOR)).otherwise(F.concat(F.coalesce(author["first"], F.lit("")), F.lit(" "), F.coalesce(author["last"], F.lit(""))))
    genres = F.when(F.size("subjects") > 0, F.array_join("subjects", ", ")).otherwise(F.lit(R.NO_GENRES))
    return metadata.select("book_id", F.try_element_at("titles", F.lit(1)).alias("title"), name.alias("author"), genres.alias("genres"), F.coalesce(F.try_element_at("descriptions", F.lit(1)), F.lit(R.NO_SYNOPSIS)).alias("synopsis"))


def assign_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata with the non-empty values of ``changes`` (book_id, title, author, genres, synopsis) in place of its own."""
    c = changes.select("book_id", F.col("title").alias("c_title"), F.col("author").alias("c_author"), F.col("genres").alias("c_genres"), F.col("synopsis").alias("c_synopsis")).dropDuplicates(["book_id"])
    j = metadata.join(c, "book_id", "left")

    def given(name: str, new: Column, old: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", new).otherwise(F.col(old)).alias(old)

    author = F.array(F.struct(F.col("c_author").alias("first"), F.lit("").alias("last")))
    return j.select(
        "book_id", given("c_title", F.array("c_title"), "titles"), given("c_author", author, "authors"), "identifiers", "language",
        given("c_genres", R.subjects_of("c_genres"), "subjects"), given("c_synopsis", F.array("c_synopsis"), "descriptions"),
    )


def part_metadata(metadata: DataFrame, plan: DataFrame) -> DataFrame:
    """(book_id, part, title, authors, identifiers, language, subjects, descriptions) of every part of a split."""
    j = plan.select("book_id", "part", "total_parts").join(metadata, "book_id", "left")
    title = part_title(F.try_element_at("titles", F.lit(1)), F.col("part"), F.col("total_parts"))
    return j.select("book_id", "part", title.alias("title"), "authors", "identifiers", "language", "subjects", "descriptions")
