"""Problems 1 and 2 as DataFrame operators on several text fields of one table: one pass, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import confusables, mojibake
from .common import arrow_map, batch_of

_FOUND = pa.schema([("id", pa.int64()), ("field", pa.string())])


def _source(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)])


def _single(name: str) -> bool:
    """Titles are single lines, where a trailing question mark may be a lost letter."""
    return name.endswith("title")


def garbled_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field) of the fields with text decoded wrongly.  Null and empty fields are never found."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, names = [], []
        for k, name in enumerate(fields):
            rows = mojibake.garbled_rows(batch.column(1 + k), _single(name))
            ids += batch.column(0).take(pa.array(rows, pa.int64())).to_pylist()
            names += [name] * len(rows)
        return batch_of(_FOUND, ids, names)

    return arrow_map(_source(df, id_col, fields), run, "id long, field string")


def confusable_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field) of the fields with look-alike characters; garbled fields are left to ``garbled_fields``."""

    data = confusables.unicode_data()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        confusables.use(data)
        ids, names = [], []
        for k, name in enumerate(fields):
            column = batch.column(1 + k)
            rows = confusables.confusable_rows(column)
            part = column.take(pa.array(rows, pa.int64()))
            garbled = set(mojibake.garbled_rows(part, _single(name)))
            rows = [r for n, r in enumerate(rows) if n not in garbled]
            ids += batch.column(0).take(pa.array(rows, pa.int64())).to_pylist()
            names += [name] * len(rows)
        return batch_of(_FOUND, ids, names)

    return arrow_map(_source(df, id_col, fields), run, "id long, field string")


def _rewritten(df: DataFrame, id_col: str, fields: list[str], work) -> DataFrame:  # noqa: ANN001
    schema = pa.schema([("id", pa.int64()), *[(f, pa.string()) for f in fields]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(schema, batch.column(0), *[pa.array(work(batch.column(1 + k), name), pa.string()) for k, name in enumerate(fields)])

    return arrow_map(_source(df, id_col, fields), run, ", ".join(["id long", *[f"`{f}` string" for f in fields]]))


def repaired(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, fields): every field with its garbled spans restored as far as possible; null stays null."""
    return _rewritten(df, id_col, fields, lambda column, name: mojibake.restored(column, _single(name)))


def normalized(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, fields): every field, repaired first, in one consistent spelling; null stays null."""
    data = confusables.unicode_data()

    def work(column: pa.Array, name: str) -> list[str | None]:
        confusables.use(data)
        return confusables.normalized(pa.array(mojibake.restored(column, _single(name)), pa.string()))

    return _rewritten(df, id_col, fields, work)
