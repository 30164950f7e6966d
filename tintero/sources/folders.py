"""Folders of loose files as DataFrames; any file system that Spark reads will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..operators.position import by_order

_EMPTY = "book_id string, ord int, file_name string, content string"
_NONE = "book_id string, href string, media_type string, data binary"


def _files(spark: SparkSession, path: str, below: bool = False) -> DataFrame | None:
    """The files of a folder (and below it), or None where there is no such folder."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower()).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def xhtml_folder(spark: SparkSession, folder: str, book_id: str = "book", inner: str = "OEBPS/Text") -> DataFrame:
    """(book_id, ord, file_name, content): ``.xhtml`` files (any case) of one folder by name, not of those below it.

    ``inner`` is '' for folders that hold the files themselves.  A missing folder gives no rows.  Only names are ordered;
    the contents are joined to their places.
    """
    files = _files(spark, f"{folder.rstrip('/')}/{inner}" if inner else folder)
    if files is None:
        return spark.createDataFrame([], _EMPTY)
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).where(F.endswith(F.lower("file_name"), F.lit(".xhtml")))
    places = by_order(named.select(F.lit(book_id).alias("book_id"), "file_name", "path"), "book_id", ["file_name"])
    return named.select("path", F.decode("content", "UTF-8").alias("content")).join(places, "path").select("book_id", (F.col("pos") + 1).alias("ord"), "file_name", "content")


def resource_folders(spark: SparkSession, folder: str, book_id: str = "book", kinds: tuple[str, ...] = ("Styles", "Fonts", "Images")) -> DataFrame:
    """(book_id, href, media_type, data) of everything below the resource folders of a book; missing ones are passed over."""
    out = None
    for kind in kinds:
        files = _files(spark, f"{folder.rstrip('/')}/OEBPS/{kind}", True)
        if files is None:
            continue
        href = F.concat(F.lit(kind + "/"), F.substring_index("path", f"/OEBPS/{kind}/", -1))
        part = files.select(F.lit(book_id).alias("book_id"), href.alias("href"), R.media_type(href).alias("media_type"), F.col("content").alias("data"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _NONE)
