"""Ranking of retrieved files: query vectors, search with floor and allow-list, diversity re-ranking, fusion, packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import vectors as V
from kelpline.plans.joins import salted_join
from kelpline.session import stored

#: Signs of a query's kind, the first that fits, and how much relevance weighs against likeness.
ANALYTICAL = r"(?i)\b(compare|vs|versus|evaluate|pros and cons|advantages|disadvantages|should we|tradeoffs?|better|worse|choose|decide|recommend)\b"
FACTUAL = r"(?i)\b(what is|how does|who is|when did|where is|define|definition|version|spec|api|format|syntax|command)\b"
WEIGHT = {"factual": 0.9, "analytical": 0.5, "exploratory": 0.7}
SHORT_QUERY = 50
#: The least cosine and the least keyword relevance that count, and the constant of reciprocal ranks.
LEAST_COSINE, LEAST_RELEVANCE, RECIPROCAL = 0.15, 0.10, 60


def off_half(c: Column, digits: int = 6) -> Column:
    """c rounded, off the half where the order of a sum would decide."""
    return F.round(c + 1e-9, digits)


def query_kind(query: Column) -> Column:
    q = F.coalesce(query, F.lit(""))
    return F.when(q.rlike(ANALYTICAL), "analytical").when((F.length(q) < SHORT_QUERY) | q.rlike(FACTUAL), "factual").otherwise("exploratory")


def kind_weight(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHT.items() for x in pair]), kind)


def file_vectors(entries: DataFrame) -> DataFrame:
    """(corpus_id, file_id, v): of each file the usable embedding of the smallest entry_id."""
    return entries.groupBy("corpus_id", "file_id").agg(F.min_by("embedding", "entry_id").alias("v"))


def mean_vector(vectors: Column) -> Column:
    """The element-wise mean of an array of vectors of one length."""
    size = F.size(vectors)
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    return F.transform(F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / size)


def asked_vectors(rows: DataFrame, by: list[str], truth_col: str, vectors: DataFrame) -> DataFrame:
    """(by, q): the mean vector of the files in truth_col, in the row's corpus. Files meet per row, as many as its list has."""
    each = rows.select(*by, F.explode(truth_col).alias("file_id")).filter("file_id is not null").distinct().join(vectors, ["corpus_id", "file_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("file_id", "v"))), lambda s: s["v"])
    return each.groupBy(*by).agg(listed.alias("vs")).select(*by, mean_vector(F.col("vs")).alias("q"))


def search(entries: DataFrame, asked: DataFrame, by: str, group: str, top: int, floor: float = LEAST_COSINE) -> DataFrame:
    """(by, group, entry_id, similarity, place): of each stated query the `top` entries of its group with a cosine of at least floor.

    entries: stored (group, entry_id, u), u of length 1; asked: (by, group, q), a
    stated set of queries. A group of many entries is split. The rank filter is applied
    per partition before the shuffle, so that only candidates move.
    """
    asked = asked.select(by, group, V.unit(F.col("q")).alias("q"))
    scored = salted_join(entries, asked, [group], "inner", F.col("entry_id")).select(by, group, "entry_id", off_half(V.dot(F.col("u"), F.col("q"))).alias("similarity")).filter(F.col("similarity") >= floor)
    w = Window.partitionBy(by, group).orderBy(F.desc("similarity"), "entry_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def with_relevance(lists: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """(run_id, corpus_id, top_k, weight, place, file_id, relevance, v) of the listed files that have a vector; lists: one row per run."""
    each = lists.select("run_id", "corpus_id", "top_k", "weight", F.posexplode("retrieved").alias("place", "file_id")).filter("file_id is not null")
    each = each.groupBy("run_id", "corpus_id", "top_k", "weight", "file_id").agg(F.min("place").alias("place"))
    return each.join(vectors, ["corpus_id", "file_id"]).join(asked, ["run_id", "corpus_id"]).withColumn("relevance", off_half(V.cosine(F.col("v"), F.col("q")))).drop("q")


def diversified(members: DataFrame) -> DataFrame:
    """(run_id, place, file_id, score): greedy choice of top_k files of each run, weight * relevance less (1 - weight) * the largest cosine to a chosen one.

    A run's list is one row; a step costs one look at each file that is left. Ties go to the earlier place.
    """
    lists = members.groupBy("run_id", "top_k", "weight").agg(F.array_sort(F.collect_list(F.struct("place", "file_id", "relevance", "v"))).alias("m"))

    def choose(top: int, weight: float, m: list) -> list[tuple]:
        v = np.stack([x["v"] for x in m])
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        relevance = np.array([x["relevance"] for x in m])
        near, left, out = np.zeros(len(m)), np.ones(len(m), bool), []
        for place in range(min(top, len(m))):
            score = np.where(left, weight * relevance - (1 - weight) * near, -np.inf)
            i = int(score.argmax())
            out.append((place + 1, m[i]["file_id"], float(score[i])))
            left[i] = False
            s = np.round(v @ v[i] + 1e-9, 6)
            near = s if place == 0 else np.maximum(near, s)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, *x) for r, top, weight, m in zip(b["run_id"], b["top_k"], b["weight"], b["m"]) for x in choose(int(top), weight, m)]
            yield pd.DataFrame(rows, columns=["run_id", "place", "file_id", "score"])

    return lists.mapInPandas(run, "run_id bigint, place int, file_id string, score double").withColumn("score", off_half(F.col("score")))


def diversity(members: DataFrame, by: str) -> DataFrame:
    """(by, files, diversity): 1 less the mean cosine of all pairs, from the length of the sum of the unit vectors; 1 for a single file."""
    sums = members.select(by, V.unit(F.col("v")).alias("u")).select(by, F.posexplode("u").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("files"))
    n = F.col("files")
    return sums.groupBy(by, "files").agg(F.sum(F.col("s") * F.col("s")).alias("square")).select(by, "files", off_half(F.when(n > 1, 1 - (F.col("square") - n) / (n * (n - 1))).otherwise(1.0), 5).alias("diversity"))


def fused_ranks(keyword: DataFrame, semantic: DataFrame, by: str, item: str, top: int) -> DataFrame:
    """(by, item, confidence, reason, place) from keyword (by, item, relevance) and semantic (by, item, similarity).

    The stronger of both raw scores decides; the reciprocal ranks, summed, break ties, then the item.
    """
    rank = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), item))
    k = keyword.filter(F.col("relevance") >= LEAST_RELEVANCE).withColumn("rk", rank("relevance"))
    s = semantic.filter(F.col("similarity") >= LEAST_COSINE).withColumn("rs", rank("similarity"))
    both = k.join(s, [by, item], "full")
    bonus = F.coalesce(1.0 / (RECIPROCAL + F.col("rk")), F.lit(0.0)) + F.coalesce(1.0 / (RECIPROCAL + F.col("rs")), F.lit(0.0))
    reason = F.when(F.col("rs").isNull(), "keyword").when(F.col("rk").isNull(), "semantic").otherwise("both")
    both = both.select(by, item, F.round(F.greatest(F.coalesce("relevance", F.lit(0.0)), F.coalesce("similarity", F.lit(0.0))), 4).alias("confidence"), F.round(bonus, 9).alias("bonus"), reason.alias("reason"))
    w = Window.partitionBy(by).orderBy(F.desc("confidence"), F.desc("bonus"), item)
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).drop("bonus")


def packed(listed: DataFrame) -> DataFrame:
    """(run_id, path, depth, cost) of rows (run_id, budget, path, relevance, tokens): whole (0) or as a pointer (4), within the budget.

    Rows stand best first. One from .4 on is whole. Of the whole ones the last
    become pointers, as far as all that come after them do not save enough; if
    pointers alone are too many, the head that fits stays. Both are sums over
    the order. Then, if under 92 % are used, pointers become whole from the head
    on wherever there is room, up to 95 %: the one step that needs what came before.
    """
    w = Window.partitionBy("run_id").orderBy(F.desc("relevance"), "tokens", "path")
    whole, pointer = F.greatest(F.lit(5), F.col("tokens")), F.greatest(F.lit(5), F.floor(F.col("tokens") * 0.03))
    rows = listed.withColumn("whole", whole).withColumn("pointer", pointer).withColumn("first", F.col("relevance") >= 0.4)
    spare = F.when(F.col("first"), F.col("whole") - F.col("pointer")).otherwise(0)
    all_ = Window.partitionBy("run_id")
    rows = rows.withColumn("spare", spare).withColumn("start", F.sum(F.when(F.col("first"), F.col("whole")).otherwise(F.col("pointer"))).over(all_))
    after = F.coalesce(F.sum("spare").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    rows = rows.withColumn("cut", F.col("first") & (F.col("start") - after > F.col("budget")))
    rows = rows.withColumn("cost", F.when(F.col("first") & ~F.col("cut"), F.col("whole")).otherwise(F.col("pointer")))
    rows = rows.withColumn("used", F.sum("cost").over(all_)).withColumn("so_far", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter((F.col("used") <= F.col("budget")) | (F.col("so_far") <= F.col("budget"))).withColumn("at", F.row_number().over(w))
    item = F.struct("at", "path", F.when(F.col("cost") == F.col("whole"), 0).otherwise(4).alias("depth"), "cost", (F.col("whole") - F.col("cost")).alias("more"), (F.col("first") & ~F.col("cut")).alias("kept"))
    lists = rows.groupBy("run_id", "budget").agg(F.sum("cost").alias("used"), F.array_sort(F.collect_list(item)).alias("items"))
    begin = F.struct(F.col("used").alias("used"), F.array().cast("array<int>").alias("raised"))

    def step(state: Column, x: Column) -> Column:
        fits = ~x["kept"] & (F.col("used") < F.col("budget") * 0.92) & (state["used"] < F.col("budget") * 0.95) & (state["used"] + x["more"] <= F.col("budget"))
        return F.struct(F.when(fits, state["used"] + x["more"]).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["raised"], x["at"])).otherwise(state["raised"]).alias("raised"))

    lists = lists.withColumn("raised", F.aggregate("items", begin, step, lambda s: s["raised"]))
    each = lists.select("run_id", "raised", F.explode("items").alias("x"))
    up = F.array_contains("raised", F.col("x.at"))
    return each.select("run_id", "x.path", F.when(F.col("x.kept") | up, 0).otherwise(4).alias("depth"), F.when(up, F.col("x.cost") + F.col("x.more")).otherwise(F.col("x.cost")).cast("bigint").alias("cost"))


def merged_with_quota(found: DataFrame, by: str, budget: int, top: int) -> DataFrame:
    """found (by, path, relevance, tokens) taken in turns, the best left of each group in each turn, while the running sum keeps within budget; best first.

    Each group offers at most `top` rows, so that turns hold groups * top rows.
    """
    turn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("relevance"), "path"))
    offered = stored(found.withColumn("turn", turn).filter(F.col("turn") <= top), "offers")
    used = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("turn", by))  # groups * top rows
    return offered.withColumn("used", used).filter(F.col("used") <= budget)
