"""Comparison of a query with its SQL."""

from __future__ import annotations

import os


def compare(spark, name: str, folder: str, queries: dict, sql: dict) -> None:
    """A query's rows against those of its SQL, as a multiset with columns by name."""
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries[name](spark, folder)
    columns = sorted(df.columns)
    r = c.sql(sql[name])
    theirs = list(r.columns)
    assert sorted(theirs) == columns

    def tidy(v):
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    mine = sorted(repr(tuple(tidy(row[k]) for k in columns)) for row in df.collect())
    other = sorted(repr(tuple(tidy(row[theirs.index(k)]) for k in columns)) for row in r.fetchall())
    assert mine == other
