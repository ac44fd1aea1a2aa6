"""Queries of the problems on training text (3, 7, 8, 9, 10) over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import leakage, pages, splitting, tokens, toxicity
from lexweave.session import table


def p3_parts(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "policies"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_parts(spark, d).where("nparts > 1 AND part = 0").select("chunk_id").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.found(table(spark, d, "elements"))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return pages.paragraphs(table(spark, d, "elements"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents of which sources."""
    hits = p9_scores(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("source").alias("sources"), F.max("words").alias("most_words"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("flagged").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(p10_scores(spark, d))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.quality(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES = {f.__name__: f for f in (p3_found, p3_parts, p7_found, p7_paragraphs, p8_ids, p9_found, p9_scores, p9_items, p10_found, p10_scores, p10_rates, p10_quality)}

#: Unicode White_Space for RE2.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

SQL = {
    "p3_found": rf"""SELECT DISTINCT chunk_id FROM chunks JOIN policies USING (policy_id)
WHERE body IS NOT NULL AND max_size > 0 AND CASE WHEN budget_unit = 'whitespace_words'
  THEN len(list_filter(regexp_split_to_array(body, '{_SPACE}'), lambda x: x <> '')) ELSE length(body) END > max_size""",
}
