"""Operators over vectors and retrieval runs: centroids, nearest entries, quantisation, fusion, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import vectors as V

DIMS = 64


def usable_entries(entries: DataFrame, dims: int = DIMS) -> DataFrame:
    return entries.filter(V.usable(F.col("embedding"), dims))


def dimension_stats(entries: DataFrame, by: str) -> DataFrame:
    """(by, i, mean, low, high): of each dimension. Exploded, but reduced with map-side combine to groups * dims rows."""
    each = entries.select(by, F.posexplode("embedding").alias("i", "x"))
    return each.groupBy(by, "i").agg(F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))


def centroids(entries: DataFrame, by: str) -> DataFrame:
    """(by, centroid): the element-wise mean; dims rows meet per group."""
    stats = dimension_stats(entries, by)
    return stats.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("centroid"))


def nearest_to(entries: DataFrame, targets: DataFrame, by: str, target_col: str, top: int) -> DataFrame:
    """The entries of each group nearest to the group's target. The rank filter is applied per partition first."""
    scored = entries.join(targets, by).withColumn("similarity", F.round(V.cosine(F.col("embedding"), F.col(target_col)), 6))
    w = Window.partitionBy(by).orderBy(F.desc("similarity"), "entry_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select(by, "entry_id", "similarity", "place")


def int8(entries: DataFrame, by: str) -> DataFrame:
    """entries with `code`: each dimension in 256 steps between its least and largest value in the group."""
    steps = dimension_stats(entries, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("s"))
    span = lambda s: F.when(s["high"] > s["low"], s["high"] - s["low"]).otherwise(1.0)
    coded = entries.join(steps, by)
    code = F.zip_with("embedding", "s", lambda x, s: F.floor((x - s["low"]) / span(s) * 255 + 0.5).cast("int"))
    return coded.withColumn("code", code).withColumn("restored", F.zip_with("code", "s", lambda c, s: s["low"] + c * span(s) / 255))


def distinct_runs(runs: DataFrame) -> DataFrame:
    return runs.dropDuplicates(["run_id"])


def metrics(runs: DataFrame) -> DataFrame:
    """runs with recall, precision, recall_at_k and f1 by their lists; 0 where a list or k is empty. Paths lose a corpus prefix."""
    plain = lambda c: F.transform(F.coalesce(F.filter(c, lambda p: p.isNotNull()), F.array().cast("array<string>")), lambda p: F.regexp_replace(p, r"^[^/:]*:", ""))
    d = runs.withColumn("got", plain("retrieved")).withColumn("truth", F.array_distinct(plain("ground_truth")))
    n = F.size("truth")
    top = F.slice("got", 1, F.greatest("top_k", F.lit(1)))
    hit = F.size(F.array_intersect("got", "truth"))
    top_hits = F.size(F.filter(top, lambda p: F.array_contains("truth", p)))
    top_found = F.size(F.array_intersect(top, F.col("truth")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumn("recall", ratio(hit, n)).withColumn("precision_k", ratio(top_hits, F.col("top_k"))).withColumn("recall_k", ratio(top_found, n)).withColumn("n_truth", n)
    return d.withColumn("f1_k", ratio(2 * F.col("precision_k") * F.col("recall_k"), F.col("precision_k") + F.col("recall_k")))


def fused(runs: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """(task_id, corpus_id, path, score, place): reciprocal rank fusion of a task's runs, ties by path."""
    listed = runs.filter("error is null").select("run_id", "task_id", "corpus_id", F.posexplode("retrieved").alias("p", "path")).filter("path is not null")
    listed = listed.groupBy("run_id", "task_id", "corpus_id", "path").agg(F.min("p").alias("p"))
    scored = listed.groupBy("task_id", "corpus_id", "path").agg(F.round(F.sum(F.lit(1.0) / (k + 1 + F.col("p"))), 9).alias("score"))
    w = Window.partitionBy("task_id", "corpus_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def bootstrap(values: DataFrame, by: str, value: str, rounds: int = 200, seed: int = 49374) -> DataFrame:
    """(by, mean, low, high): 95 % interval of the mean by Poisson resampling.

    Every row draws its own weight in each round from a hash of its id, and
    the rounds are summed with map-side combine; no group is collected.
    """
    u = lambda r: F.pmod(F.xxhash64("id", r, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cuts = np.cumsum([np.exp(-1) / float(np.prod(range(1, i + 1))) for i in range(7)])
    draws = values.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", u(F.col("round")))
    weight = sum((F.col("u") >= float(c)).cast("int") for c in cuts)
    means = draws.withColumn("w", weight).groupBy(by, "round").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    around = means.groupBy(by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return values.groupBy(by).agg(F.avg(value).alias("mean")).join(around, by)


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
