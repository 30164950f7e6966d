"""Helpers shared by the training-data operators."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpointed

TAG = re.compile(r"<[^>]*>")


def strip_tags(text: str, put: str = "") -> str:
    """The text without tags; what follows the last ``>`` can't be one, so the time is linear in any text."""
    last = text.rfind(">") + 1
    return TAG.sub(put, text[:last]) + text[last:] if last else text


def visible(line: str) -> str:
    """Visible text of one line of HTML: tags dropped, references decoded, white space collapsed."""
    if "<" in line:
        line = strip_tags(line)
    if "&" in line:
        line = html.unescape(line)
    return " ".join(line.split())


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a table, so the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def materialize(df: DataFrame) -> DataFrame:
    """Writes an intermediate result once to the cluster's shared checkpoint folder; a lost executor's work is read again from there."""
    return checkpointed(df)


FILTER_BITS = 24


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of ``2 ** bits`` bits in which the leading bits of every (mixed) long of the column are set.

    Its size is fixed (2 MB by default) whatever the number of keys; keys that aren't among them may pass
    ``may_hold``, so what passes has still to be joined or counted exactly.
    """
    at = f"shiftrightunsigned(`{column}`, {64 - bits})"
    words = keys.select(F.expr(f"shiftrightunsigned({at}, 6)").alias("w"), F.expr(f"shiftleft(1L, CAST({at} & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) the filter lets pass."""
    at = keys >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function on one batch; batches without rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays, cast to the schema."""
    arrays = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lines_with(column: pa.Array, pattern: str) -> list[tuple[int, list[int], list[str]]]:
    """(row, line numbers, lines) of the lines in which RE2 finds the pattern; rows without such lines are left out."""
    suspect = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, pattern), False))
    if not len(suspect):
        return []
    lines = pc.split_pattern(column.take(suspect), "\n")
    flat, parents = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
    at = pc.indices_nonzero(pc.match_substring_regex(flat, pattern)).to_numpy().astype(np.int64)
    first = np.searchsorted(parents, parents[at])
    out: list[tuple[int, list[int], list[str]]] = []
    for row, no, line in zip(suspect.to_numpy()[parents[at]].tolist(), (at - first).tolist(), flat.take(pa.array(at)).to_pylist(), strict=True):
        if not out or out[-1][0] != row:
            out.append((row, [], []))
        out[-1][1].append(no)
        out[-1][2].append(line)
    return out


def put_lines(texts: list[str | None], row: int, numbers: list[int], new: list[str]) -> None:
    """Puts lines back into a text in place."""
    parts = (texts[row] or "").split("\n")
    for no, line in zip(numbers, new, strict=True):
        parts[no] = line
    texts[row] = "\n".join(parts)
