"""Whole flows: pages to chapters, chapters to books, books to parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..operators import audit as A
from ..operators import book as B
from ..operators import extract as X
from ..operators import normalize as N
from ..sources import archive as Z
from ..sources.store import checkpointed


def pages_to_chapters(pages: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, rejects) of raw pages; both read one plan, so cache or write it if both are wanted."""
    found = X.extract(pages, config)
    number, _ = R.chapter_number("title", "url")
    chapters = X.chapters_of(found).withColumn("chapter_no", number).withColumn("file_name", F.when(F.col("chapter_no").isNotNull(), R.chapter_file("chapter_no")))
    return chapters, X.rejects_of(found)


def one_per_file(chapters: DataFrame) -> DataFrame:
    """(book_id, file_name, title, content_html): of chapters fetched again the latest non-null text."""
    best = F.struct("fetched_at", "chapter_id")
    return chapters.where("content_html IS NOT NULL").groupBy("book_id", "file_name").agg(F.max_by(F.struct("title", "content_html"), best).alias("c")).select("book_id", "file_name", "c.title", "c.content_html")


def _meta(metadata: DataFrame) -> DataFrame:
    return metadata.select("book_id", F.try_element_at("titles", F.lit(1)).alias("title"), "authors", "language", "subjects", "descriptions", "identifiers")


def built_books(chapters: DataFrame, metadata: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(book_id, content): an EPUB per book of the metadata, the information page first and then its chapters by file name."""
    files = one_per_file(chapters)
    page = B.chapter_page(F.coalesce("title", F.lit("")), F.col("content_html"))
    own = files.join(metadata.select("book_id"), "book_id", "left_semi").select("book_id", F.concat(F.lit("1"), "file_name").alias("ord"), F.col("file_name").alias("name"), F.regexp_replace("file_name", r"\.xhtml$", "").alias("title"), page.alias("xhtml"))
    m = B.metadata_fields(metadata).join(A.first_last_number(files, "book_id", "file_name"), "book_id")
    info = B.info_page(*[F.col(c) for c in ("title", "author", "genres", "synopsis", "first_no", "last_no", "total")])
    first = m.select("book_id", F.lit("0").alias("ord"), F.lit("info.xhtml").alias("name"), F.lit("Información").alias("title"), info.alias("xhtml"))
    return Z.build_books(first.unionByName(own), _meta(metadata), ["book_id"], resources)


def older_books(chapters: DataFrame, metadata: DataFrame, style: str = "Styles/stylesheet.css") -> DataFrame:
    """(book_id, content): an EPUB per book as the older builder made them: a synopsis page where there is one, then the loose files.

    Title, author, synopsis and genres are those given, without defaults.
    """
    files = one_per_file(chapters)
    page = B.chapter_page(F.coalesce("title", F.lit("")), F.col("content_html"))
    own = files.join(metadata.select("book_id"), "book_id", "left_semi").select("book_id", F.concat(F.lit("1"), "file_name").alias("ord"), F.col("file_name").alias("name"), F.replace("file_name", F.lit(".xhtml"), F.lit("")).alias("title"), page.alias("xhtml"))
    synopsis = F.try_element_at("descriptions", F.lit(1))
    told = metadata.where(F.coalesce(synopsis, F.lit("")) != "").join(files.select("book_id").distinct(), "book_id", "left_semi")
    first = told.select("book_id", F.lit("0").alias("ord"), F.lit("sinopsis.xhtml").alias("name"), F.lit("Sinopsis").alias("title"), B.synopsis_page(synopsis, F.array_join("subjects", ", "), style).alias("xhtml"))
    return Z.build_books(first.unionByName(own), _meta(metadata), ["book_id"])


def opened_books(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, files, texts) of archives (archive, content): the read books, their resources with bytes, and their XHTML as text."""
    found = checkpointed(found.select("archive", "content"))
    read = checkpointed(Z.books(found).where("error IS NULL"))
    files = checkpointed(Z.resource_files(read, Z.unpacked(Z.entries(found))))
    return read, files, Z.xhtml_resources(files).withColumn("content", F.decode("data", "UTF-8"))


def _written(read: DataFrame, files: DataFrame, edited: DataFrame, titles: DataFrame) -> DataFrame:
    """(book_id, content): books with edited texts (book_id, href, xhtml) and titles of contents' entries (book_id, href, new_title).

    Sections are written below ``Text/``; other files, the reading order and the metadata stay.
    """
    named = Z.toc_of(read).where("parent_id IS NULL").groupBy("book_id", "href").agg(F.min_by("title", "pos").alias("toc_title"))
    spine, at = Z.spine_of(read), ["book_id", "href"]
    sections = spine.join(edited, at).join(named, at, "left").join(titles, at, "left")
    placed = sections.select("book_id", F.col("spine_idx").alias("ord"), F.regexp_replace("href", "^Text/", "").alias("name"), F.coalesce("new_title", "toc_title", "href").alias("title"), "xhtml")
    other = files.join(spine, at, "left_anti").where(F.col("media_type") != "application/x-dtbncx+xml").join(edited, at, "left")
    meta = read.select(F.col("archive").alias("book_id"), "title", "authors", "language", "subjects", "descriptions", "identifiers")
    return Z.build_books(placed, meta, ["book_id"], other.select(*at, F.coalesce(F.encode("xhtml", "UTF-8"), "data").alias("data"), "is_cover"))


def _keyed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("id", F.concat_ws("\n", "book_id", "href"))


def _unkeyed(done: DataFrame) -> DataFrame:
    return done.select(F.split("id", "\n")[0].alias("book_id"), F.split("id", "\n")[1].alias("href"), F.col("content").alias("xhtml"))


def edited_books(found: DataFrame) -> DataFrame:
    """(book_id, content): books read from their archives, their headings put in standard form, and written again.

    Headings, titles and the contents' entries change as ``heading_changes`` plans.
    """
    read, files, texts = opened_books(found)
    changes = checkpointed(B.heading_changes(texts, Z.toc_of(read)))
    pages = _unkeyed(N.rewritten_heads(_keyed(texts.join(changes, ["book_id", "href"], "left")), "id", "content", "new_title"))
    return _written(read, files, pages, changes.select("book_id", "href", "new_title"))


def cleaned_books(found: DataFrame) -> DataFrame:
    """(book_id, content): books whose XHTML keeps the first valid heading of each level only, read and written again."""
    read, files, texts = opened_books(found)
    none = read.select(F.col("archive").alias("book_id"), F.lit("").alias("href"), F.lit(None).cast("string").alias("new_title")).where("false")
    return _written(read, files, _unkeyed(N.cleaned(_keyed(texts), "id", "content")), none)


def book_problems(texts: DataFrame) -> DataFrame:
    """(book_id, href, h1, title, bad_form, mismatch) of the XHTML of books whose heading has no valid form, or isn't the title."""
    read = texts.select("book_id", "href", R.tag_text("content", "h1").alias("h1"), R.tag_text("content", "title").alias("title"))
    bad = F.col("h1").isNull() | (F.col("h1") == "") | ~R.valid_heading("h1")
    differ = F.coalesce(R.java_trim("h1") != R.java_trim("title"), F.lit(False))
    return read.select("*", bad.alias("bad_form"), differ.alias("mismatch")).where("bad_form OR mismatch")


def split_books(spine: DataFrame, plan: DataFrame, chapters: DataFrame, metadata: DataFrame, resources: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(book_id, part, content): an EPUB per part of a plan; shared resources go into each, named sections get their title.

    ``resources`` has (book_id, href, data, is_cover).  A section without text becomes an empty page.
    """
    placed = B.sections_of_parts(spine, plan)
    named = titles if titles is not None else spine.select("book_id", "href").distinct().withColumn("title", F.col("href"))
    labelled = placed.join(named, ["book_id", "href"], "left").withColumn("file_name", F.element_at(F.split("href", "/"), -1))
    texts = one_per_file(chapters).select("book_id", "file_name", F.col("title").alias("chapter_title"), "content_html")
    full = labelled.join(texts, ["book_id", "file_name"], "left")
    page = B.chapter_page(F.coalesce("chapter_title", "title", "href"), F.coalesce("content_html", F.lit("")))
    own = full.select("book_id", "part", (F.col("pos") + 1).alias("ord"), F.col("file_name").alias("name"), F.coalesce("title", "href").alias("title"), page.alias("xhtml"))
    span = labelled.groupBy("book_id", "part").agg(F.min_by("file_name", "pos").alias("a"), F.max_by("file_name", "pos").alias("z"))
    m = span.join(B.metadata_fields(metadata), "book_id", "left")
    number = [F.coalesce(R.file_number(c), F.lit(0)) for c in ("a", "z")]
    info = B.info_page(F.col("title"), F.col("author"), F.col("genres"), F.col("synopsis"), *number)
    first = m.select("book_id", "part", F.lit(0).alias("ord"), F.lit("info.xhtml").alias("name"), F.lit("Información").alias("title"), info.alias("xhtml"))
    shared = B.shared_resources(resources, spine, plan).join(resources.select("book_id", "href", "data"), ["book_id", "href"]).withColumn("is_cover", F.lit(False))
    covers = resources.where("is_cover").join(plan.select("book_id", "part"), "book_id").select("book_id", "href", "part", "data", "is_cover")
    return Z.build_books(first.unionByName(own), B.part_metadata(metadata, plan), ["book_id", "part"], shared.unionByName(covers))
