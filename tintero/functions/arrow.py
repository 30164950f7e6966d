"""Batch functions on Arrow data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_rows(df: DataFrame, fn: Callable[[dict], list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Each row to any number of rows, in Arrow batches; ``fn`` must not raise for bad data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in fn(row)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.mapInArrow(run, ddl)
