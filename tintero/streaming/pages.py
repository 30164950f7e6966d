"""The same plans on streams: pages arrive as files or messages, chapters and links leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..operators import extract as X


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """Raw pages from Parquet files that are added to a folder."""
    return spark.readStream.format("parquet").schema(schema).load(folder)


def extracted_stream(pages: DataFrame, config: DataFrame) -> DataFrame:
    """Chapters and rejects as they come; stateless, so it runs as on tables."""
    return X.extract(pages, config)


def latest_links(links: DataFrame, delay: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(window, index_url, chapter_no, url): within each event-time window the last URL seen of each chapter number.

    ``links`` has (index_url, chapter_no, url, pos, seen_at); rows later than ``delay`` are dropped with their state.
    """
    timed = links.where("chapter_no IS NOT NULL AND seen_at IS NOT NULL").withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", delay)
    best = F.struct("seen_at", "pos", "url")
    grouped = timed.groupBy(F.window("seen_at", window), "index_url", "chapter_no").agg(F.max(best).alias("best"))
    return grouped.select(F.col("window.start").alias("window_start"), "index_url", "chapter_no", F.col("best.url").alias("url"))


def first_deliveries(chapters: DataFrame, delay: str = "1 day") -> DataFrame:
    """Chapters without those fetched again within the delay."""
    timed = chapters.where("fetched_at IS NOT NULL").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", delay)
    return timed.dropDuplicatesWithinWatermark(["url"])


def issue_stream(files: DataFrame, content_col: str = "content_html") -> DataFrame:
    """Files with their markup issues and repaired text."""
    return files.withColumn("issues", R.markup_issues(content_col)).withColumn("repaired", R.repair_markup(content_col))
