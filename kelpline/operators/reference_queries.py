"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import references as R
from kelpline.tables import table


def _ledger(spark: SparkSession, sf_dir: str, ends: bool = False) -> DataFrame:
    return R.maintained(R.entity_deltas(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_deletions"), table(spark, sf_dir, "source_records"), ends))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.ledger_orphans(_ledger(spark, sf_dir))
    return found.select(F.col("field").alias("ref_field"), "row_id", "ref_id", F.date_format("at", "yyyy-MM").alias("ref_month"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per field and month."""
    return p5_found(spark, sf_dir).groupBy("ref_field", "ref_month").agg(F.count(F.lit(1)).alias("orphan_refs"), F.countDistinct("ref_id").alias("orphan_keys"), F.countDistinct("row_id").alias("rows_affected"))


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that do not exist now, with the references of all rows ever delivered, as its SQL counts; p5_live counts those that stand now."""
    counts = R.ledger_counts(_ledger(spark, sf_dir), ends=False)
    return R.current_orphans(counts).select(F.col("field").alias("ref_field"), "ref_id", "refs")


def p5_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are referenced now, by the last row of an entity that is not deleted, and do not exist now."""
    counts = R.ledger_counts(_ledger(spark, sf_dir, ends=True))
    return R.current_orphans(counts).select(F.col("field").alias("ref_field"), "ref_id", "refs")


_BASE = r"""
with raw as (
  select 'wiki_links' as ref_field, row_id, updated_at, unnest(wiki_links) as ref from entities
  union all
  select 'evidence', row_id, updated_at, unnest(list_transform(evidence, lambda x: x.source_id)) from entities),
refs as (
  select distinct ref_field, row_id, updated_at, lower(regexp_replace(ref, '^\s+|\s+$', '', 'g')) as ref_id from raw where ref is not null),
good as (select * from refs where ref_id <> '' and not starts_with(ref_id, 'https://')),
born as (
  select 'wiki_links' as ref_field, lower(trim(id)) as ref_id, min(created_at) as t from entities where id is not null group by 1, 2
  union all
  select 'evidence', lower(trim(source_id)), min(ingested_at) from source_records where source_id is not null group by 1, 2),
died as (
  select 'wiki_links' as ref_field, lower(trim(entity_id)) as ref_id, min(deleted_at) as t from entity_deletions group by 1, 2
  union all
  select 'evidence', lower(trim(source_id)), min(deleted_at) from source_records group by 1, 2),
found as (
  select g.ref_field, g.row_id, g.ref_id, strftime(g.updated_at, '%Y-%m') as ref_month
  from good g left join born b using (ref_field, ref_id) left join died d using (ref_field, ref_id)
  where b.t is null or b.t > g.updated_at or (d.t is not null and d.t <= g.updated_at))
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_current": p5_current, "p5_live": p5_live}

SQL = {
    "p5_found": _BASE + "select * from found",
    "p5_report": _BASE + "select ref_field, ref_month, count(*) as orphan_refs, count(distinct ref_id) as orphan_keys, count(distinct row_id) as rows_affected from found group by 1, 2",
    "p5_current": _BASE + """
select g.ref_field, g.ref_id, count(*) as refs from good g left join born b using (ref_field, ref_id) left join died d using (ref_field, ref_id)
where (case when b.t is null then 0 else 1 end) - (case when d.t is null then 0 else 1 end) <= 0 group by 1, 2""",
    "p5_live": _BASE + """,
live as (
  select row_id from entities e where not exists (select 1 from entity_deletions d where d.deleted_at is not null and lower(trim(d.entity_id)) = lower(trim(e.id)))
  qualify e.id is null or row_number() over (partition by lower(trim(e.id)) order by e.updated_at desc nulls last, e.row_id desc) = 1)
select g.ref_field, g.ref_id, count(*) as refs from good g join live using (row_id) left join born b using (ref_field, ref_id) left join died d using (ref_field, ref_id)
where (case when b.t is null then 0 else 1 end) - (case when d.t is null then 0 else 1 end) <= 0 group by 1, 2""",
}
