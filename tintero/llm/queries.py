"""The pN_ queries over the whole test tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, fields, language, packing, residue, sitelines, tokens
from .common import table

TEXTS = ["title", "content_html"]
TOKENIZER = "byte_bpe_50k"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.confusable_fields(table(spark, sf_dir, "chapters", "chapter_id", *TEXTS), "chapter_id", TEXTS).withColumnRenamed("id", "chapter_id")


def p1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.normalized(table(spark, sf_dir, "chapters", "chapter_id", *TEXTS), "chapter_id", TEXTS).withColumnRenamed("id", "chapter_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.garbled_fields(table(spark, sf_dir, "chapters", "chapter_id", *TEXTS), "chapter_id", TEXTS).withColumnRenamed("id", "chapter_id")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.repaired(table(spark, sf_dir, "chapters", "chapter_id", *TEXTS), "chapter_id", TEXTS).withColumnRenamed("id", "chapter_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters", "chapter_id", "site", "content_html")
    unusable = residue.unusable(chapters, "chapter_id", "site", ["content_html"]).select("id")
    return blocks.boilerplate_lines(chapters, "chapter_id", "content_html").join(unusable, "id", "left_anti").withColumnRenamed("id", "chapter_id")


def p3_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters", "chapter_id", "content_html")
    return blocks.main_content(chapters, "chapter_id", "content_html").withColumnRenamed("id", "chapter_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters", "chapter_id", "site", *TEXTS)
    return residue.unusable(chapters, "chapter_id", "site", TEXTS).select(F.col("id").alias("chapter_id"), "field")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters", "chapter_id", "site", *TEXTS)
    return residue.unusable(chapters, "chapter_id", "site", TEXTS).withColumnRenamed("id", "chapter_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters", "chapter_id", "site", "content_html")
    return sitelines.repeated_lines(chapters, "chapter_id", "site", "content_html").withColumnRenamed("id", "chapter_id")


def p5_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters", "chapter_id", "site", "content_html")
    return sitelines.without_repeated_lines(chapters, "chapter_id", "site", "content_html").select(F.col("id").alias("chapter_id"), F.col("text").alias("content_html"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", TOKENIZER).withColumnRenamed("id", "doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = table(spark, sf_dir, "token_budgets", "budget_id", "capacity_tokens", "tokenizer")
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    names = budgets.select("tokenizer").distinct().limit(101).collect()
    if len(names) > 100:
        raise ValueError("too many tokenizers to lay out at once")
    if not names:
        return spark.createDataFrame([], packing._RESULT).withColumnRenamed("id", "doc_id")
    parts = []
    for (name,) in sorted(names):
        sizes = tokens.token_counts(documents, "doc_id", "text", name)
        parts.append(packing.containers(sizes, budgets.where(F.col("tokenizer") == name), "id", "n_tokens"))
    packed = parts[0]
    for more in parts[1:]:
        packed = packed.unionByName(more)
    return packed.withColumnRenamed("id", "doc_id")


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_summary(p7_containers(spark, sf_dir), table(spark, sf_dir, "token_budgets", "budget_id", "capacity_tokens"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "lang_labels", "label", "lang")
    return language.mislabelled_segments(documents, labels, "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return language.document_segments(documents, "doc_id", "text").drop("label").withColumnRenamed("id", "doc_id")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.document_languages(documents, "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_normalized, p2_found, p2_repaired, p3_found, p3_main_content, p4_found, p4_kinds, p5_found, p5_removed,
            p6_ids, p7_containers, p7_summary, p8_found, p8_segments, p8_documents,
        )
    }


# References named in the test data; DuckDB has no function that decodes them.  "&amp;" comes last.
_NAMED = {
    "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ", "uuml": "ü", "Aacute": "Á", "Eacute": "É", "Iacute": "Í", "Oacute": "Ó", "Uacute": "Ú", "Ntilde": "Ñ", "Uuml": "Ü",
    "iquest": "¿", "iexcl": "¡", "laquo": "«", "raquo": "»", "mdash": "—", "ndash": "\u2013", "hellip": "\u2026", "middot": "\u00b7", "copy": "\u00a9", "nbsp": " ", "quot": '"', "apos": "''", "lt": "<", "gt": ">", "ordf": "ª", "ordm": "º", "amp": "&",
}


def _visible_sql(column: str) -> str:
    text = f"regexp_replace({column}, '<[^>]*>', '', 'g')"
    for name, ch in _NAMED.items():
        text = f"replace({text}, '&{name};', '{ch}')"
    return text


def oracle_sql() -> dict[str, str]:
    blanks = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    key = f"trim(regexp_replace(regexp_replace(lower({_visible_sql('line')}), '\\p{{Nd}}+', '', 'g'), '{blanks}', ' ', 'g'))"
    return {
        "p5_found": f"""
            WITH rows AS (SELECT chapter_id, site, string_split(content_html, chr(10)) AS parts FROM chapters WHERE content_html IS NOT NULL),
            lines AS (SELECT chapter_id, site, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM rows),
            keyed AS (SELECT chapter_id, site, line_no, {key} AS k FROM lines),
            kept AS (SELECT * FROM keyed WHERE length(regexp_replace(k, '[^\\p{{L}}]', '', 'g')) >= 10),
            totals AS (SELECT site, count(*) AS total FROM rows GROUP BY site),
            many AS (SELECT site, k FROM kept JOIN totals USING (site) GROUP BY site, k, total HAVING count(DISTINCT chapter_id) >= 5 AND count(DISTINCT chapter_id) * 10 >= total)
            SELECT chapter_id, CAST(line_no AS INTEGER) AS line_no FROM kept JOIN many USING (site, k)""",
    }
