"""Passages of evaluation items inside a corpus, by a positional inverted index.

The corpus is stored as postings (term, doc_id, pos) of the terms that occur in
the items. Of each window of `span` words of an item, the terms that are rarest
in the whole corpus ask the index, rarest first; their postings, shifted by the
item's positions, are intersected: where enough of them fall on the same offset
the passage may stand. Of a window that keeps its share of words, so many of the
asking terms must be the same that this loses nothing. At these places the
document's postings are laid beside the item: a match is a stretch
of at least `span` item words of which `share` are the same (proximity), or all
of them (exact phrase). Words of few items weigh more: without `rare_share` of
the weight, document and item only share a pattern of words that many items have.

Words are runs of letters and digits, lower-cased, after invisible characters,
markup, escapes and hyphens at line ends are taken away. An item's first and
last sentence do not count if another item has the same.

Defined cases: null, empty or wordless texts and null ids match nothing; repeated documents
match each; items with fewer than `span` words are not looked for; empty tables
give an empty result; ties in rarity go to the earlier position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.plans.joins import broadcast_if_small, salted_join
from kelpline.session import stored

SPAN, SHARE, RARE_SHARE = 15, 0.8, 0.45
MEET = 2  # asking terms that must fall on the same offset


def _where(test: Callable[[Column], Column], change: Callable[[Column], Column], t: Column) -> Column:
    """change(t) if test(t); t is evaluated once."""
    return F.element_at(F.transform(F.array(t), lambda x: F.when(test(x), change(x)).otherwise(x)), 1)


def words(text: Column) -> Column:
    """The comparable words of a text, in order. Costly patterns run only where their first sign is found."""
    has = lambda sign: lambda x: F.contains(x, F.lit(sign))
    t = _where(has("\\"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\\[nrt]", "\n"), r"\\u[0-9a-fA-F]{4}|\\", " "), text)
    t = F.regexp_replace(t, r"\p{Cf}", "")
    t = _where(has("&"), lambda x: F.regexp_replace(x, r"(?i)&(shy|zwj|zwnj|zerowidthspace|#173|#820[3-7]);", ""), t)
    t = _where(has("<"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)<wbr\s*/?>", ""), r"(?i)</?[a-z][^<>\n]{0,120}>", " "), t)
    t = _where(has("&"), lambda x: F.regexp_replace(x, r"(?i)&(#\d{1,6}|#x[0-9a-f]{1,5}|[a-z]{2,8});", " "), t)
    t = _where(lambda x: x.rlike(r"[-‐‑]\s*?[\r\n]"), lambda x: F.regexp_replace(x, r"(?<=[\p{L}\p{N}])[-‐‑]\s*?[\r\n][\s>#*/|]*(?=[\p{L}\p{N}])", ""), t)
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), 0)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) without first and last sentences that several items share."""
    parts = items.filter("text is not null and item_id is not null").select("item_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("at", "sentence")).withColumn("w", words(F.col("sentence")))
    parts = parts.withColumn("last", F.max("at").over(Window.partitionBy("item_id")))
    edge = parts.filter("at = 0 or at = last")
    shared = edge.groupBy("w").agg(F.countDistinct("item_id").alias("n")).filter("n > 1").select("w", F.lit(True).alias("shared"))
    kept = parts.join(shared, "w", "left").filter("shared is null or (at <> 0 and at <> last)")
    grouped = kept.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("s"))
    return grouped.select("item_id", F.flatten(F.col("s.w")).alias("words"))


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of the given terms. terms is broadcast only if it is counted to be small."""
    return tokens.select("doc_id", F.posexplode("words").alias("pos", "term")).join(broadcast_if_small(terms, 200_000), "term", "left_semi")


def asking(span: int, share: float, meet: int) -> int:
    """How many terms of a window must ask so that `meet` of them are the same wherever `share` of the window is."""
    return min(span, span - int(np.ceil(span * share - 1e-9)) + meet)


def rarest_terms(items: DataFrame, counts: DataFrame, span: int, rarest: int) -> DataFrame:
    """(item_id, term, at): positions that are among the rarest of some window of the item. Terms that no document holds ask for nothing, but count."""
    places = items.filter(F.size("words") >= span).select("item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    windows = places.withColumn("window", F.explode(F.sequence(F.greatest(F.col("at") - (span - 1), F.lit(0)), F.least("at", F.col("n") - span))))
    rank = F.row_number().over(Window.partitionBy("item_id", "window").orderBy(F.coalesce("count", F.lit(0)), "at"))
    return windows.withColumn("r", rank).filter((F.col("r") <= rarest) & F.col("count").isNotNull()).select("item_id", "term", "at").distinct()


def longest_match(at: np.ndarray, n: int, weight: np.ndarray, span: int, share: float, rare_share: float) -> int:
    """The length of the longest stretch of at least span item positions, both ends the same, that holds together; else 0.

    at: the positions, in order, that are the same; n and weight: of all the
    item's positions. share of the stretch and rare_share of its weight must be
    the same. With s the running sum of (same - share), a stretch (i, j] has its
    share if s[j] >= s[i]; so for the weights. Begins that cannot give a longer
    stretch than the best are not tried.
    """
    if len(at) < span * share - 1e-9:
        return 0
    same = np.zeros(n)
    same[at] = 1
    sums = [np.concatenate([[0.0], np.cumsum(gain)]) for gain in (same - share, weight * (same - rare_share))]
    end, best = at + 1, span - 1
    for k, begin in enumerate(at):
        if end[-1] - begin <= best:
            break
        reach = end[k:]
        good = reach[np.logical_and.reduce([s[reach] - s[begin] >= -1e-9 for s in sums])]
        if len(good):
            best = max(best, int(good[-1] - begin))
    return best if best >= span else 0


def _verified(span: int, share: float, rare_share: float):
    """Of rows (doc_id, item_id, offsets, pos, terms, words, weights) the longest match at each offset; terms and words are hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, item, offsets, pos, terms, own, weight in zip(*(batch[c] for c in ("doc_id", "item_id", "offsets", "pos", "terms", "words", "weights"))):
                at = pos[:, None] - offsets[None, :]
                same = (at >= 0) & (at < len(own))
                same &= own[np.where(same, at, 0)] == terms[:, None]
                for k in np.flatnonzero(same.sum(axis=0) >= span * share - 1e-9):
                    if n := longest_match(np.sort(at[same[:, k], k]), len(own), weight, span, share, rare_share):
                        rows.append((doc, item, offsets[k], n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "at", "matched"])

    return run


def weighted(items: DataFrame) -> DataFrame:
    """items with `weights`: of each word the squared log of the items over those that have it; what all items share weighs nothing."""
    each = items.select("item_id", F.posexplode("words").alias("i", "term"))
    spread = each.groupBy("term").agg(F.countDistinct("item_id").alias("n"))
    each = each.join(spread, "term").select("item_id", "i", F.pow(F.log(F.lit(items.count() + 1.0) / F.col("n")), 2).alias("w"))
    return items.join(each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("e")), "item_id").select("item_id", "words", F.col("e.w").alias("weights"))


def leaked_passages(documents: DataFrame, items: DataFrame, span: int = SPAN, share: float = SHARE, rare_share: float = RARE_SHARE, meet: int = MEET) -> DataFrame:
    """(doc_id, item_id, at, matched): where and how long passages of items stand in documents.

    at: the word of the document where the item's first counted word would
    stand. One row per document, item and offset. The postings of a document
    that has places meet in one row, as many as it has such words.
    """
    wanted = stored(item_words(items), "items")
    terms = stored(wanted.select(F.explode("words").alias("term")).distinct(), "terms")
    tokens = documents.filter("text is not null and doc_id is not null").select("doc_id", words(F.col("text")).alias("words"))
    index = stored(postings(tokens, terms), "postings")
    counts = stored(index.groupBy("term").count(), "counts")
    asks = stored(rarest_terms(wanted, counts, span, asking(span, share, meet)), "asks")
    hits = salted_join(index, asks, ["term"], "inner", F.struct("doc_id", "pos"))
    places = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= meet)
    places = stored(places.select("doc_id", "item_id", "offset"), "places")

    posted = index.join(places.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("pos", F.xxhash64("term").alias("term"))).alias("p"))
    asked = places.groupBy("doc_id", "item_id").agg(F.collect_list("offset").alias("offsets"))
    own = weighted(wanted).select("item_id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"), "weights")
    both = asked.join(posted.select("doc_id", F.col("p.pos").alias("pos"), F.col("p.term").alias("terms")), "doc_id").join(broadcast_if_small(stored(own, "own_words")), "item_id")
    return both.mapInPandas(_verified(span, share, rare_share), "doc_id bigint, item_id bigint, at int, matched int")
