"""Audits of a chapter set; each gives rows of problems, and counts come from aggregating them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_rules as R
from .position import bucket_of


def format_problems(files: DataFrame, h1: str = "h1") -> DataFrame:
    """Files whose first h1 is missing, empty or not of the form ``Capítulo N ... name``."""
    return files.where(F.col(h1).isNull() | (F.col(h1) == "") | ~R.valid_heading(h1))


def title_mismatches(files: DataFrame, h1: str = "h1", title: str = "title", strict: bool = True) -> DataFrame:
    """Files whose h1 and title differ after trimming; with ``strict`` also those that lack one of them."""
    differ = R.java_trim(h1) != R.java_trim(title)
    missing = F.col(h1).isNull() | F.col(title).isNull()
    return files.where(missing | differ) if strict else files.where(~missing & differ)


def issue_rows(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, ord, code): one row per defect, in the order of the report."""
    return files.select(F.col(id_col).alias("id"), F.posexplode(R.markup_issues(content_col)).alias("ord", "code"))


def issues_by_file(rows: DataFrame) -> DataFrame:
    """(id, codes): the defects of each file in order."""
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"]).alias("codes"))


def changed_count(df: DataFrame, *by: str, changed: str = "changed") -> DataFrame:
    """(by, n_files, n_changed)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col(changed)).alias("n_changed"))


def chapter_files(files: DataFrame, name_col: str) -> DataFrame:
    """Files that are chapters: neither tables of contents nor info pages."""
    return files.where(~F.lower(name_col).rlike("toc|info"))


def _spans(numbers: DataFrame, book: str, number: str) -> DataFrame:
    return numbers.where(F.col(number).isNotNull()).groupBy(book).agg(F.count(F.lit(1)).alias("n_found"), F.max(number).alias("max_no"))


def missing_chapters(numbers: DataFrame, book: str = "book_id", number: str = "chapter_no") -> DataFrame:
    """(book, chapter_no): numbers from 1 to the book's largest that it lacks.

    Gaps are read off neighbouring numbers, so no full sequence is built and joined.  Neighbours are sought within
    buckets of numbers; a bucket's first number follows the largest of the buckets before it.  So no task holds a whole
    book, and a gap of n numbers costs n rows, which are the result.
    """
    have = numbers.where(F.col(number) > 0).select(book, F.col(number).alias("n")).distinct().withColumn("_bucket", bucket_of("n"))
    near = have.withColumn("p", F.lag("n").over(Window.partitionBy(book, "_bucket").orderBy("n"))).where("p IS NOT NULL")
    ends = have.groupBy(book, "_bucket").agg(F.min("n").alias("n"), F.max("n").alias("most"))
    far = ends.withColumn("p", F.coalesce(F.lag("most").over(Window.partitionBy(book).orderBy("_bucket")), F.lit(0)))
    gaps = near.select(book, "n", "p").unionByName(far.select(book, "n", "p")).where(F.col("n") - F.col("p") > 1)
    return gaps.select(book, F.explode(F.sequence(F.col("p") + 1, F.col("n") - 1)).alias("chapter_no"))


def missing_report(numbers: DataFrame, book: str = "book_id", number: str = "chapter_no") -> DataFrame:
    """(book, n_found, max_no, n_missing, missing): counts with duplicates and the missing numbers in order."""
    gaps = missing_chapters(numbers, book, number).groupBy(book).agg(F.count(F.lit(1)).alias("n_missing"), F.array_join(F.sort_array(F.collect_list("chapter_no")), ", ").alias("missing"))
    return _spans(numbers, book, number).join(gaps, book, "left").select(book, "n_found", "max_no", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("missing", F.lit("")).alias("missing"))


def first_last_number(files: DataFrame, book: str, name_col: str) -> DataFrame:
    """(book, first_no, last_no, total): numbers of the first and last chapter file by name, 0 where a name has none."""
    chapters = chapter_files(files, name_col)
    number: Column = F.coalesce(R.file_number(name_col), F.lit(0))
    return chapters.groupBy(book).agg(F.min_by(number, name_col).alias("first_no"), F.max_by(number, name_col).alias("last_no"), F.count(F.lit(1)).alias("total"))
