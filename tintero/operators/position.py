"""Places of rows in their group's order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed

WIDTH = 100_000  # numbers of a bucket, so at most so many distinct numbers in a window


def bucket_of(number: str, width: int = WIDTH) -> Column:
    return F.coalesce(F.floor(F.col(number) / width), F.lit(-1 << 40))


def by_number(df: DataFrame, by: str, number: str, name: str = "pos", width: int = WIDTH) -> DataFrame:
    """Adds ``name``: the place from 0 by an integer column (nulls first) within ``by``.

    Rows are numbered within buckets of their number, and each bucket adds the rows of those before it, so a group that
    holds a third of all rows is spread over as many tasks as it has buckets.
    """
    b = df.withColumn("_bucket", bucket_of(number, width))
    counts = b.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = b.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(number)))
    joined = local.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_offset") + F.col("_local") - 1).cast("int").alias(name))


def by_order(df: DataFrame, by: str, order: list[str], name: str = "pos", costly: bool = False) -> DataFrame:
    """Adds ``name``: the place from 0 by any columns within ``by``.

    The ranges are found from a sample of the rows, which runs the plan once more; ``costly`` rows (small results of much
    work) are therefore written first.

    The rows are range-partitioned by group and order and written once; each range is numbered by itself and adds the
    rows of its group in the ranges before it.
    """
    df = checkpointed(df) if costly else df
    ranges = checkpointed(df.repartitionByRange(F.col(by), *[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = ranges.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)))
    joined = local.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_offset") + F.col("_local") - 1).cast("int").alias(name))
