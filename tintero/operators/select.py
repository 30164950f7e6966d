"""Which chapters of an index are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text_rules import as_int, java_trim


def in_range(index: DataFrame, first: int, last: int) -> DataFrame:
    """Chapters of the index from ``first`` to ``last``, both included; none if they are the wrong way round."""
    return index.where(F.col("chapter_no").between(first, last))


def one(index: DataFrame, number: int) -> DataFrame:
    return index.where(F.col("chapter_no") == number)


def up_to(index: DataFrame, last: int | None = None) -> DataFrame:
    """All chapters, or those up to a number."""
    return index if last is None else index.where(F.col("chapter_no") <= last)


def requested_numbers(requests: DataFrame, text_col: str = "request") -> DataFrame:
    """(chapter_no): the distinct numbers of texts such as ``10, 25``; a text with anything else counts as a whole for nothing."""
    numbers = F.transform(F.split(F.col(text_col), ","), lambda x: as_int(java_trim(x)))
    good = ~F.exists(numbers, lambda x: x.isNull())
    return requests.where(good).select(F.explode(numbers).alias("chapter_no")).distinct()


def listed(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested chapters that the index has."""
    return index.join(wanted.select("chapter_no").distinct(), "chapter_no", "left_semi")


def not_found(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested numbers that the index lacks."""
    return wanted.select("chapter_no").distinct().join(index.select("chapter_no"), "chapter_no", "left_anti")


def select_chapters(index: DataFrame, mode: str, **options: object) -> DataFrame:
    """The five ways of asking for chapters: all, up_to, range, one, list."""
    if mode == "all":
        return up_to(index)
    if mode == "up_to":
        return up_to(index, int(options["last"]))  # type: ignore[call-overload]
    if mode == "range":
        return in_range(index, int(options["first"]), int(options["last"]))  # type: ignore[call-overload]
    if mode == "one":
        return one(index, int(options["number"]))  # type: ignore[call-overload]
    if mode == "list":
        return listed(index, options["wanted"])  # type: ignore[arg-type]
    raise ValueError(f"no such mode: {mode}")
