from __future__ import annotations

import pytest

from compare import compare
from tintero.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, data, name):
    compare(spark, name, data, Q.QUERIES, Q.SQL)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs_over_whole_tables(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0


def test_stream_gives_the_last_windows_too(spark, data):
    from tintero.streaming import pages as P

    from pyspark.sql import functions as F

    whole = P.latest_links(Q.table(spark, data, "chapter_links")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    assert sorted(map(repr, Q.QUERIES["stream_latest_links"](spark, data).collect())) == sorted(map(repr, whole.collect()))


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_is_free_of_the_subpackage():
    import pathlib

    root = pathlib.Path(Q.__file__).parent.parent
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            assert "llm" not in p.read_text(encoding="utf-8"), p
