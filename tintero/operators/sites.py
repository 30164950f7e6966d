"""Site dispatch: which configuration row holds for a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG = ("site", "sel_content", "sel_title", "sel_index_container", "sel_list_item", "sel_link", "sel_number", "sel_next")
# A configuration is a dimension written by hand; more rows than this are refused.
MOST_SITES = 1_000


def dispatch(df: DataFrame, config: DataFrame, url_col: str = "url", default_site: str | None = None, longest_token_first: bool = False) -> DataFrame:
    """Adds the columns of the first configuration (by priority) whose token the URL contains.

    Tokens compare in lower case where ``case_insensitive`` holds.  URLs without a match (null ones too) take the row of
    ``default_site``, or nulls.  The few rows become one CASE expression, so nothing is joined or shuffled.
    """
    rows = config.select("priority", "url_token", "case_insensitive", *CONFIG).limit(MOST_SITES + 1).collect()
    if len(rows) > MOST_SITES:
        raise ValueError(f"a site configuration has at most {MOST_SITES} rows")
    rows.sort(key=lambda r: ((-len(r["url_token"] or ""), r["priority"]) if longest_token_first else (r["priority"], 0)))
    kind = T.StructType([T.StructField(c, T.StringType()) for c in CONFIG])

    def as_struct(r: T.Row) -> Column:
        return F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in CONFIG])

    chosen = F.when(F.lit(False), F.lit(None).cast(kind))
    for r in rows:
        if r["url_token"]:
            url = F.lower(url_col) if r["case_insensitive"] else F.col(url_col)
            chosen = chosen.when(F.contains(url, F.lit(r["url_token"].lower() if r["case_insensitive"] else r["url_token"])), as_struct(r))
    default = next((r for r in rows if default_site and r["site"] == default_site), None)
    out = df.withColumn("_config", chosen.otherwise(as_struct(default)) if default else chosen)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in CONFIG], *[F.col(f"_config.{c}").alias(c) for c in CONFIG])
