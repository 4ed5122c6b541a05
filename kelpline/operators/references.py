"""Orphan references from a ledger of signed changes.

An entry of the ledger is +1 or -1 to the existence of a key (row_id is null) or
to the references to it (row_id is the referring row), at a time. Entries are
told apart by key, row and sign, and the earliest time counts, so batches may
come in any order, late, and more than once. Per key the signs sum to how often
it is referenced and whether it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.plans.joins import salted_join
from kelpline.session import stored

ENTRY = ["field", "ref_id", "row_id", "sign"]


def clean_ref(ref: Column) -> Column:
    """A reference trimmed of white space and lower-cased."""
    return F.lower(F.regexp_replace(ref, r"(?U)^\s+|\s+$", ""))


def existence_deltas(created: DataFrame, deleted: DataFrame) -> DataFrame:
    """(field, ref_id, at, existence): +1 at the earliest creation, -1 at the earliest deletion.

    created and deleted have field, ref_id, at. Keys or times that are null
    give no delta; repeated rows count once, as the earliest.
    """
    first = lambda df, sign: df.filter("ref_id is not null and at is not null").groupBy("field", "ref_id").agg(F.min("at").alias("at")).withColumn("existence", F.lit(sign))
    return first(created, 1).unionByName(first(deleted, -1))


def existence_state(deltas: DataFrame) -> DataFrame:
    """One row per key from its deltas: exists_from inclusive, exists_until exclusive."""
    at = lambda sign: F.min(F.when(F.col("existence") == sign, F.col("at")))
    return deltas.groupBy("field", "ref_id").agg(at(1).alias("exists_from"), at(-1).alias("exists_until"))


def orphans(references: DataFrame, state: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """The references (field, ref_id, at, and any other columns) whose target does not exist at `at`.

    A reference adds +1 to its key; the key's existence at `at` is the sum of
    the deltas up to `at`: 1 from exists_from to before exists_until, else 0.
    References with positive count and zero existence come out. A null `at`
    is kept as an orphan only if the key never existed. One key may hold a
    large part of the references: it is salted, and the state has one row per key.
    """
    joined = salted_join(references, state, ["field", "ref_id"], "left", F.struct(*references.columns), hot_rows)
    existence = (F.coalesce(F.col("exists_from") <= F.col("at"), F.col("exists_from").isNotNull()).cast("int") - F.coalesce(F.col("exists_until") <= F.col("at"), F.lit(False)).cast("int"))
    return joined.withColumn("existence", existence).filter("existence <= 0").drop("existence", "exists_from", "exists_until")


def apply_deltas(ledger: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The ledger (field, ref_id, row_id, sign, at) after a batch of entries of the same columns; no ledger is an empty one.

    A repeated entry changes nothing but may move its time to the front. The
    row is part of what is grouped by, so that a key of many references is spread.
    """
    batch = deltas.filter("ref_id is not null").select(*ENTRY, "at")
    return (ledger.select(*ENTRY, "at").unionByName(batch) if ledger is not None else batch).groupBy(*ENTRY).agg(F.min("at").alias("at"))


def ledger_counts(ledger: DataFrame, ends: bool = True) -> DataFrame:
    """(field, ref_id, refs, existence): the signed counts per key, summed with map-side combine; without ends references only add."""
    counted = F.when(F.col("row_id").isNotNull(), F.col("sign") if ends else F.greatest("sign", F.lit(0))).otherwise(0)
    return ledger.groupBy("field", "ref_id").agg(F.sum(counted).alias("refs"), F.sum(F.when(F.col("row_id").isNull(), F.col("sign")).otherwise(0)).alias("existence"))


def current_orphans(counts: DataFrame) -> DataFrame:
    """Keys with positive references and no existence."""
    return counts.filter("refs > 0 and existence <= 0")


def ledger_orphans(ledger: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """The references (field, ref_id, row_id, at) of a stored ledger whose key's existence counted no more than zero at their time."""
    alive = existence_state(ledger.filter("row_id is null").withColumnRenamed("sign", "existence"))
    return orphans(ledger.filter("row_id is not null and sign = 1").drop("sign"), alive, hot_rows)


def maintained(deltas: DataFrame, last_days: int = 30) -> DataFrame:
    """The stored ledger after two batches of deltas (with `arrived`): what had arrived `last_days` before the end, and the rest."""
    deltas = stored(deltas, "deltas")
    cut = deltas.agg(F.max("arrived") - F.expr(f"interval {last_days} days")).first()[0]
    late = F.coalesce(F.col("arrived") > F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    ledger = stored(apply_deltas(None, deltas.filter(~late)), "ledger")
    return stored(apply_deltas(ledger, deltas.filter(late)), "ledger")


def entity_references(entities: DataFrame, arrived: str | None = None) -> DataFrame:
    """(field, row_id, ref_id, at) of wiki_links and evidence.source_id, distinct per row; with the column `arrived`, if named.

    Null items, blank items and values that begin with https:// are no
    references. Null or empty arrays give nothing.
    """
    more = [F.col(arrived).alias("arrived")] if arrived else []
    of = lambda field, items: entities.select(F.lit(field).alias("field"), "row_id", F.explode(items).alias("ref"), F.col("updated_at").alias("at"), *more)
    both = of("wiki_links", F.col("wiki_links")).unionByName(of("evidence", F.col("evidence.source_id")))
    return both.withColumn("ref_id", clean_ref("ref")).filter("row_id is not null and ref_id <> '' and not startswith(ref_id, 'https://')").select("field", "row_id", "ref_id", "at", *["arrived"] * bool(arrived)).distinct()


def reference_deltas(entities: DataFrame, deletions: DataFrame) -> DataFrame:
    """(field, ref_id, row_id, at, refs): +1 at a row's updated_at; -1 for all but the last row of an id, at the last one, and for those of a deleted entity.

    Rows of one id follow each other by updated_at, then row_id. A deletion
    before the row ends its references at once. Rows without an id stay. The
    last row of an id is found with map-side combine, and an id of many rows is split.
    """
    gone = deletions.filter("entity_id is not null and deleted_at is not null").groupBy(clean_ref(F.col("entity_id")).alias("_id")).agg(F.min("deleted_at").alias("_gone"))
    rows = stored(entities.select("row_id", "updated_at", clean_ref(F.col("id")).alias("_id")).filter("_id is not null"), "entity_rows")
    last = rows.groupBy("_id").agg(F.max(F.struct("updated_at", "row_id")).alias("_last")).join(gone, "_id", "left")
    ended = salted_join(rows, last, ["_id"], "inner", F.col("row_id"))
    ended = ended.withColumn("until", F.greatest(F.least(F.when(F.col("row_id") != F.col("_last.row_id"), F.col("_last.updated_at")), "_gone"), "updated_at"))
    ended = ended.filter("until is not null and (row_id <> _last.row_id or _gone is not null)").select("row_id", "until")
    refs = entity_references(entities)
    ends = refs.join(ended, "row_id").select("field", "ref_id", "row_id", F.col("until").alias("at"), F.lit(-1).cast("bigint").alias("refs"))
    return refs.select("field", "ref_id", "row_id", "at", F.lit(1).cast("bigint").alias("refs")).unionByName(ends)


def entity_existence(entities: DataFrame, deletions: DataFrame, records: DataFrame) -> DataFrame:
    """The existence deltas of entities and of source records."""
    key = lambda df, field, ref, at: df.select(F.lit(field).alias("field"), clean_ref(ref).alias("ref_id"), F.col(at).alias("at"))
    created = key(entities, "wiki_links", "id", "created_at").unionByName(key(records, "evidence", "source_id", "ingested_at"))
    deleted = key(deletions, "wiki_links", "entity_id", "deleted_at").unionByName(key(records, "evidence", "source_id", "deleted_at"))
    return existence_deltas(created, deleted)


def entity_deltas(entities: DataFrame, deletions: DataFrame, records: DataFrame, ends: bool = False) -> DataFrame:
    """The entries of all references and of all that they can refer to, with the time they arrived; the ends of references if asked for."""
    alive = entity_existence(entities, deletions, records).select("field", "ref_id", F.lit(None).cast("bigint").alias("row_id"), F.col("existence").cast("bigint").alias("sign"), "at", F.col("at").alias("arrived"))
    arrived = entities.select("row_id", F.col("ingested_at").alias("arrived"))
    if not ends:
        refs = entity_references(entities, "ingested_at").withColumn("refs", F.lit(1).cast("bigint"))
    else:
        refs = reference_deltas(entities, deletions).join(arrived, "row_id", "left")
    return alive.unionByName(refs.select("field", "ref_id", "row_id", F.col("refs").alias("sign"), "at", "arrived"))
