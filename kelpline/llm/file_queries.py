"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.handwritten import not_by_hand
from kelpline.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(table(spark, sf_dir, "embedding_entries"), table(spark, sf_dir, "source_files")).select("corpus_id", "file_id")


def p3_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each corpus, how many files are not by hand, and how many of them bear an open sign."""
    found = not_by_hand(table(spark, sf_dir, "embedding_entries"), table(spark, sf_dir, "source_files"))
    return found.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("files"), F.count_if("giveaway").alias("with_sign"))


QUERIES = {"p3_found": p3_found, "p3_corpora": p3_corpora}

SQL = {}
