"""Queries of problems 1 and 2 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.neighbours import similar_vectors
from kelpline.llm.subset import runs_with_members, varied_of_lists, varied_subset
from kelpline.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least 0.9 where one is among the ten best of the other."""
    best = similar_vectors(table(spark, sf_dir, "embedding_entries"), "entry_id", "embedding", k=10, floor=0.9)
    return best.select(F.least("id", "neighbour").alias("entry_a"), F.greatest("id", "neighbour").alias("entry_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every entry whose id is divisible by 100, against all entries; hashes, tables and probes follow from their number."""
    return similar_vectors(table(spark, sf_dir, "embedding_entries"), "entry_id", "embedding", k=10, asking="entry_id % 100 = 0").withColumnRenamed("id", "entry_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = runs_with_members(table(spark, sf_dir, "retrieval_runs"), table(spark, sf_dir, "embedding_entries"))
    return varied_of_lists(lists, "top_k", "members").select("run_id", F.explode("chosen").alias("file_id"))


def p2_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred varied files of each corpus, the latest embedded of each chosen cell."""
    entries = table(spark, sf_dir, "embedding_entries").withColumn("_age", -F.unix_micros(F.col("embedded_at").cast("timestamp")))
    return varied_subset(entries, "corpus_id", "entry_id", "_age", "embedding", 100).select(F.col("grp").alias("corpus_id"), F.col("id").alias("entry_id"), "key")


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_corpus": p2_corpus}

_USABLE = """with u as (select * from embedding_entries where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""
_SIMILAR = "round(list_cosine_similarity(a.embedding, b.embedding), 6)"

SQL = {
    "p1_found": _USABLE + f""", s as (select a.entry_id as a, b.entry_id as b, {_SIMILAR} as s from u a join u b on a.entry_id <> b.entry_id where {_SIMILAR} >= 0.9),
r as (select a, b from (select *, row_number() over (partition by a order by s desc, b) as k from s) where k <= 10)
select distinct least(a, b) as entry_a, greatest(a, b) as entry_b from r""",
    "p1_neighbours": _USABLE + f""", s as (select a.entry_id, b.entry_id as neighbour, {_SIMILAR} as similarity from u a join u b on a.entry_id <> b.entry_id where a.entry_id % 100 = 0)
select * from (select *, row_number() over (partition by entry_id order by similarity desc, neighbour)::int as place from s) where place <= 10""",
    "p2_found": _USABLE + """, f as (select corpus_id, file_id, arg_min(embedding, entry_id) as embedding from u group by 1, 2),
r as (select distinct on (run_id) * from retrieval_runs where rerank = 'mmr' and error is null),
l as (select run_id, corpus_id, file_id, min(i) as i from (select run_id, corpus_id, generate_subscripts(retrieved, 1) as i, unnest(retrieved) as file_id from r) where file_id is not null group by 1, 2, 3),
m as (select run_id, file_id, i, embedding from l join f using (corpus_id, file_id))
select run_id, file_id from m a where not exists (select 1 from m b where b.run_id = a.run_id and b.i < a.i and round(list_cosine_similarity(a.embedding, b.embedding), 6) >= 0.9)""",
}
