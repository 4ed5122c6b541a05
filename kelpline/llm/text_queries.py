"""Queries of problems 6, 7 and 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import language, leakage, tokenizer
from kelpline.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.with_ids(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, documents and tokens per 1000 characters of each source."""
    docs = tokenizer.with_ids(table(spark, sf_dir, "documents").select("source", "text"))
    n = F.size("ids").cast("bigint")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"), F.round(1000 * F.sum(n) / F.nullif(F.sum(F.char_length("text")), F.lit(0)), 3).alias("tokens_per_1000_chars"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaked item: its documents and the longest stretch of words found."""
    found = leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("matched").alias("longest"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.document_languages(language.labelled(documents))
    return language.mislabelled(documents, found).select("doc_id", "lang").distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of one language with its confidence."""
    return language.labelled(table(spark, sf_dir, "documents"))


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments, "p6_ids": p6_ids, "p6_counts": p6_counts, "p7_found": p7_found, "p7_items": p7_items}

SQL = {}
