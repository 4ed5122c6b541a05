"""Queries over vectors and retrieval runs and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import vectors as V
from kelpline.operators import retrieval as R
from kelpline.tables import table


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usable_entries(table(spark, sf_dir, "embedding_entries"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_runs(table(spark, sf_dir, "retrieval_runs"))


def vec_coverage(spark, sf_dir):
    """Of each corpus and model, why entries' vectors cannot be used."""
    e = F.col("embedding")
    why = F.when(e.isNull(), "null").when(F.size(e) == 0, "empty").when(F.size(e) != 64, "length").when(F.exists(e, lambda x: x.isNull() | F.isnan(x)), "not a number").when(~F.exists(e, lambda x: x != 0), "zero").otherwise("usable")
    return table(spark, sf_dir, "embedding_entries").groupBy("corpus_id", "model", why.alias("state")).agg(F.count(F.lit(1)).alias("entries"))


def vec_centroids(spark, sf_dir):
    stats = R.dimension_stats(_usable(spark, sf_dir), "corpus_id")
    return stats.select("corpus_id", "i", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "low", "high")  # off the half, where the order of the sum would decide


def vec_nearest_to_centroid(spark, sf_dir):
    entries = _usable(spark, sf_dir)
    return R.nearest_to(entries.select("corpus_id", "entry_id", "embedding"), R.centroids(entries, "corpus_id"), "corpus_id", "centroid", 10).select("corpus_id", "place", "similarity")


def vec_int8_error(spark, sf_dir):
    coded = R.int8(_usable(spark, sf_dir).select("corpus_id", "embedding"), "corpus_id")
    return coded.groupBy("corpus_id").agg(F.round(F.min(V.cosine(F.col("embedding"), F.col("restored"))), 5).alias("least_cosine"), F.count(F.lit(1)).alias("entries"))


def vec_signs(spark, sf_dir):
    """Entries of each corpus whose 64 sign bits other entries share."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    return _usable(spark, sf_dir).groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("entries"), F.min("entry_id").alias("first_entry")).filter("entries > 1")


def vec_changed(spark, sf_dir):
    """Files whose last embedding was made from other content than the last one indexed, per corpus."""
    from kelpline.operators.files import latest

    last = table(spark, sf_dir, "embedding_entries").filter("content_hash is not null").groupBy("corpus_id", "file_id").agg(F.max_by("content_hash", F.struct("embedded_at", "entry_id")).alias("embedded_hash"))
    files = latest(table(spark, sf_dir, "source_files")).select("corpus_id", F.col("path").alias("file_id"), "hash")
    both = files.join(last, ["corpus_id", "file_id"], "left")
    state = F.when(F.col("embedded_hash").isNull(), "new").when(F.col("embedded_hash") == F.col("hash"), "same").otherwise("changed")
    return both.groupBy("corpus_id", state.alias("state")).agg(F.count(F.lit(1)).alias("files"))


def vec_late(spark, sf_dir):
    """Entries that arrived more than a day after they were made, per corpus, with the longest delay in hours."""
    hours = F.floor((F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("embedded_at").cast("timestamp"))) / 3_600_000_000)
    return table(spark, sf_dir, "embedding_entries").withColumn("h", hours).filter("h >= 24").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("late"), F.max("h").alias("longest_hours"))


def run_metrics(spark, sf_dir):
    r6 = lambda c: F.round(c, 6).alias(c)
    return R.metrics(_runs(spark, sf_dir)).select("run_id", r6("recall"), r6("precision_k"), r6("recall_k"), r6("f1_k"), "n_truth")


def run_summary(spark, sf_dir):
    """Mean metrics of each configuration over runs without error that have a truth."""
    m = R.metrics(_runs(spark, sf_dir).filter("error is null"))
    mean = lambda c: F.round(F.avg(F.when(F.col("n_truth") > 0, F.col(c))), 6).alias(c)
    return m.groupBy("config", "mode", "rerank").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("n_truth") == 0).alias("without_truth"), mean("recall"), mean("precision_k"), mean("f1_k"))


def run_stored_metrics(spark, sf_dir):
    """Runs whose stored recall differs from the recall of their lists."""
    m = R.metrics(_runs(spark, sf_dir).filter("error is null and retrieved is not null"))
    return m.select("run_id", F.round("recall", 6).alias("recall"), F.round("metrics.file_recall", 6).alias("stored")).filter("not (stored <=> recall)")


def run_fused(spark, sf_dir):
    return R.fused(_runs(spark, sf_dir)).select("task_id", "corpus_id", "path", "score", "place")


def run_overlap(spark, sf_dir):
    """Jaccard overlap of the first five paths of a task's runs with the task's first run."""
    runs = _runs(spark, sf_dir).filter("error is null").select("run_id", "task_id", F.array_distinct(F.slice(F.filter(F.coalesce("retrieved", F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, 5)).alias("five"))
    first = runs.groupBy("task_id").agg(F.min_by("five", "run_id").alias("first_five"), F.min("run_id").alias("first_run"))
    return runs.join(first, "task_id").filter("run_id <> first_run").select("task_id", "run_id", "first_run", F.round(R.jaccard(F.col("five"), F.col("first_five")), 6).alias("overlap"))


def run_missing_files(spark, sf_dir):
    """Retrieved paths that the run's corpus has no entry for."""
    listed = _runs(spark, sf_dir).select("run_id", "corpus_id", F.explode("retrieved").alias("file_id")).filter("file_id is not null").distinct()
    known = table(spark, sf_dir, "embedding_entries").select("corpus_id", "file_id").distinct()
    return listed.join(known, ["corpus_id", "file_id"], "left_anti").select("run_id", "corpus_id", "file_id")


def run_by_month(spark, sf_dir):
    """Runs, failures and median time by month and corpus, with subtotals."""
    month = F.date_format("started_at", "yyyy-MM")
    rows = _runs(spark, sf_dir).select(month.alias("month"), "corpus_id", "error", "took_s")
    return rows.rollup("month", "corpus_id").agg(F.count(F.lit(1)).alias("runs"), F.count("error").alias("failed"), F.round(F.percentile("took_s", 0.5), 6).alias("median_s"))


def run_interval(spark, sf_dir):
    """Mean recall of each configuration with a bootstrap interval."""
    m = R.metrics(_runs(spark, sf_dir).filter("error is null")).filter("n_truth > 0").select("config", F.col("run_id").alias("id"), "recall")
    return R.bootstrap(m, "config", "recall").select("config", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


QUERIES = {f.__name__: f for f in [vec_coverage, vec_centroids, vec_nearest_to_centroid, vec_int8_error, vec_signs, vec_changed, vec_late, run_metrics, run_summary, run_stored_metrics, run_fused, run_overlap, run_missing_files, run_by_month, run_interval]}

_OK = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_D = f"with u as (select * from embedding_entries where {_OK}), d as (select corpus_id, i, avg(x) as mean, min(x) as low, max(x) as high from (select corpus_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x from u) group by 1, 2)\n"
_R = """with r as (select * exclude (_k) from (select *, row_number() over (partition by run_id order by recorded_at) as _k from retrieval_runs) where _k = 1),
g as (select *, list_transform(list_filter(coalesce(retrieved, []), lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', '')) as got, list_distinct(list_transform(list_filter(coalesce(ground_truth, []), lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', ''))) as truth from r),
h as (select *, len(truth) as n_truth, case when len(truth) > 0 then len(list_intersect(got, truth)) / len(truth)::double else 0.0::double end as recall,
 case when top_k > 0 then len(list_filter(got[1:greatest(top_k, 1)], lambda p: list_contains(truth, p))) / top_k::double else 0.0::double end as precision_k, case when len(truth) > 0 then len(list_intersect(got[1:greatest(top_k, 1)], truth)) / len(truth)::double else 0.0::double end as recall_k from g),
m as (select *, case when precision_k + recall_k > 0 then 2.0::double * precision_k * recall_k / (precision_k + recall_k) else 0.0::double end as f1_k from h)
"""

SQL = {
    "vec_coverage": "select corpus_id, model, case when embedding is null then 'null' when len(embedding) = 0 then 'empty' when len(embedding) <> 64 then 'length' when len(list_filter(embedding, lambda x: x is null or isnan(x))) > 0 then 'not a number' when len(list_filter(embedding, lambda x: x <> 0)) = 0 then 'zero' else 'usable' end as state, count(*) as entries from embedding_entries group by 1, 2, 3",
    "vec_centroids": _D + "select corpus_id, i::int as i, round(mean + 1e-9, 6) as mean, low, high from d",
    "vec_nearest_to_centroid": _D + """, c as (select corpus_id, list(mean order by i) as centroid from d group by 1)
select corpus_id, place, similarity from (select corpus_id, entry_id, similarity, row_number() over (partition by corpus_id order by similarity desc, entry_id) as place from (select u.corpus_id, entry_id, round(list_cosine_similarity(embedding, centroid), 6) as similarity from u join c using (corpus_id))) where place <= 10""",
    "vec_int8_error": _D + """, s as (select corpus_id, list(low order by i) as low, list(case when high > low then high - low else 1.0 end order by i) as span from d group by 1),
q as (select u.corpus_id, embedding, list_transform(range(1, 65), lambda i: low[i] + floor((embedding[i] - low[i]) / span[i] * 255 + 0.5) * span[i] / 255) as restored from u join s using (corpus_id))
select corpus_id, round(min(list_cosine_similarity(embedding, restored)), 5) as least_cosine, count(*) as entries from q group by 1""",
    "vec_signs": f"select array_to_string(list_transform(embedding, lambda x: case when x >= 0 then '1' else '0' end), '') as bits, count(*) as entries, min(entry_id) as first_entry from embedding_entries where {_OK} group by 1 having count(*) > 1",
    "vec_changed": """with f as (select corpus_id, path as file_id, hash from (select *, row_number() over (partition by corpus_id, path order by indexed_at desc, hash desc nulls last, tokens desc) as k from source_files) where k = 1),
e as (select corpus_id, file_id, content_hash from (select *, row_number() over (partition by corpus_id, file_id order by embedded_at desc, entry_id desc) as k from embedding_entries where content_hash is not null) where k = 1)
select corpus_id, case when content_hash is null then 'new' when content_hash = hash then 'same' else 'changed' end as state, count(*) as files from f left join e using (corpus_id, file_id) group by 1, 2""",
    "vec_late": "select corpus_id, count(*) as late, max(h) as longest_hours from (select corpus_id, floor((epoch_us(ingested_at) - epoch_us(embedded_at)) / 3600000000.0)::bigint as h from embedding_entries) where h >= 24 group by 1",
    "run_metrics": _R + "select run_id, round(recall, 6) as recall, round(precision_k, 6) as precision_k, round(recall_k, 6) as recall_k, round(f1_k, 6) as f1_k, n_truth from m",
    "run_summary": _R + "select config, mode, rerank, count(*) as runs, count(*) filter (n_truth = 0) as without_truth, round(avg(recall) filter (n_truth > 0), 6) as recall, round(avg(precision_k) filter (n_truth > 0), 6) as precision_k, round(avg(f1_k) filter (n_truth > 0), 6) as f1_k from m where error is null group by 1, 2, 3",
    "run_stored_metrics": _R + "select run_id, round(recall, 6) as recall, round(metrics.file_recall, 6) as stored from m where error is null and retrieved is not null and round(metrics.file_recall, 6) is distinct from round(recall, 6)",
    "run_fused": _R + """, l as (select run_id, task_id, corpus_id, path, min(p) as p from (select run_id, task_id, corpus_id, generate_subscripts(retrieved, 1) - 1 as p, unnest(retrieved) as path from r where error is null) where path is not null group by 1, 2, 3, 4),
s as (select task_id, corpus_id, path, round(sum(1.0::double / (61 + p)), 9) as score from l group by 1, 2, 3)
select * from (select *, row_number() over (partition by task_id, corpus_id order by score desc, path) as place from s) where place <= 10""",
    "run_overlap": _R + """, f as (select run_id, task_id, list_distinct(list_filter(coalesce(retrieved, []), lambda x: x is not null)[1:5]) as five from r where error is null), a as (select task_id, min(run_id) as first_run, arg_min(five, run_id) as first_five from f group by 1)
select task_id, run_id, first_run, round(case when len(list_distinct(list_concat(five, first_five))) = 0 then 1.0::double else len(list_intersect(five, first_five)) / len(list_distinct(list_concat(five, first_five)))::double end, 6) as overlap from f join a using (task_id) where run_id <> first_run""",
    "run_missing_files": "select distinct run_id, corpus_id, file_id from (select run_id, corpus_id, unnest(retrieved) as file_id from retrieval_runs) where file_id is not null and (corpus_id, file_id) not in (select corpus_id, file_id from embedding_entries where corpus_id is not null and file_id is not null)",
    "run_by_month": _R + "select month, corpus_id, count(*) as runs, count(error) as failed, round(quantile_cont(took_s, 0.5), 6) as median_s from (select strftime(started_at, '%Y-%m') as month, corpus_id, error, took_s from r) group by rollup (month, corpus_id)",
}
