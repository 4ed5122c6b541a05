"""Operators over link graphs: weights, damping of hubs, traversal, impact, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.plans.joins import hot_keys, salted_join
from kelpline.session import stored

#: How strong a kind of edge is.
WEIGHTS = {"links_to": 0.5, "references": 0.4, "depends_on": 0.4}
HUB, DECAY, BACK = 10, 0.65, 0.7


def entity_edges(rows: DataFrame) -> DataFrame:
    """(source, target, kind, weight), distinct: links, cited sources and affiliations of entities."""
    of = lambda kind, items: rows.select(F.col("id").alias("source"), F.explode(items).alias("t"), F.lit(kind).alias("kind"), F.lit(WEIGHTS[kind]).alias("weight"))
    all_ = of("links_to", F.col("wiki_links")).unionByName(of("references", F.col("evidence.source_id"))).unionByName(of("depends_on", F.col("person.affiliations")))
    clean = all_.withColumn("target", F.lower(F.trim("t"))).filter("t is not null and target <> '' and not startswith(target, 'https://') and target <> source")
    return clean.select("source", "target", "kind", "weight").distinct()


def damped(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """Weights of edges into a target of more than `hub` edges of the kind fall with the log of their number.

    The degrees are an aggregate with map-side combine that is joined back, not
    a window over a hub's edges.
    """
    degree = edges.groupBy("target", "kind").agg(F.count(F.lit(1)).alias("degree"))
    lower = F.when(F.col("degree") > hub, F.col("weight") / (1 + F.log2(F.col("degree") / hub))).otherwise(F.col("weight"))
    return edges.join(degree, ["target", "kind"]).select("source", "target", "kind", F.round(lower, 6).alias("weight"))


def traverse(edges: DataFrame, start: DataFrame, depth: int = 3, least: float = 0.05, back: bool = False) -> DataFrame:
    """(id, relevance): from start (id, relevance) along edges; relevance times weight times DECAY per hop, the best way counts.

    One join and one map-side combined max per hop.
    """
    ways = edges.select("source", "target", "weight")
    if back:
        ways = ways.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("weight") * BACK).alias("weight")))
    best = start.select("id", "relevance")
    frontier = best
    for _ in range(depth):
        reached = frontier.join(ways, frontier["id"] == ways["source"]).select(F.col("target").alias("id"), F.round(F.col("relevance") * F.col("weight") * DECAY, 9).alias("relevance")).filter(F.col("relevance") >= least)
        frontier = stored(reached.groupBy("id").agg(F.max("relevance").alias("relevance")), "frontier")
        best = best.unionByName(frontier)
    return best.groupBy("id").agg(F.max("relevance").alias("relevance"))


def impact(edges: DataFrame, changed: DataFrame, hops: int = 3, hub: int = HUB) -> DataFrame:
    """(id, hops, risk): what refers to the changed ids, directly or through others; hubs are reported but not followed."""
    inbound = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub).select(F.col("target").alias("id"))
    seen = changed.select("id", F.lit(0).alias("hops"))
    frontier = changed.select("id")
    for hop in range(1, hops + 1):
        new = frontier.join(edges, frontier["id"] == edges["target"]).select(F.col("source").alias("id")).distinct().join(seen, "id", "left_anti")
        new = stored(new, "impact")
        seen = seen.unionByName(new.withColumn("hops", F.lit(hop)))
        frontier = new.join(inbound, "id", "left_anti")
    return seen.filter("hops > 0").withColumn("risk", F.round(1.0 / (1 + F.col("hops")), 6))


def communities(edges: DataFrame, rounds: int = 15) -> DataFrame:
    """(id, label): synchronous weighted label propagation until nothing changes, `rounds` at most; ties go to the smaller label.

    A node's own label counts with a quarter, so that pairs do not swap labels
    for ever. Rounds are stored tables; votes are summed with map-side combine,
    and a hub's ties are split.
    """
    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    both = stored(both.groupBy("source", "target").agg(F.sum("weight").alias("weight")), "ties")
    hot = hot_keys(both, ["target"])
    labels = stored(both.select(F.col("source").alias("id"), F.col("source").alias("label")).distinct(), "labels")
    for _ in range(rounds):
        votes = salted_join(both, labels.withColumnRenamed("id", "target"), ["target"], "inner", F.col("source"), hot=hot).select(F.col("source").alias("id"), "label", "weight").unionByName(labels.select("id", "label", F.lit(0.25).alias("weight")))
        tally = votes.groupBy("id", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        new = tally.groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label"))
        new = stored(new.join(labels.withColumnRenamed("label", "was"), "id"), "labels")
        labels = new.select("id", "label")
        if new.filter("label <> was").isEmpty():
            break
    return labels


def cluster_names(labels: DataFrame, edges: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(label, members, inside, across, name) of the communities of at least `least` members.

    name: the kind (of rows: id, kind, topics) that seven of ten members share,
    else the two most common topics, else the label.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least)
    ends = edges.join(labels.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(labels.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
    inside = ends.filter("a = b").groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("inside"))
    across = ends.filter("a <> b").select(F.explode(F.array("a", "b")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("across"))
    known = labels.join(rows, "id")
    best = lambda counted, k: F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), counted))), 1, k)
    kinds = known.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("less"), "kind")).alias("k"))
    topics = known.select("label", F.explode("topics").alias("topic")).filter("topic is not null").groupBy("label", "topic").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "topic")
    topics = topics.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("label").agg(best("topic", 2).alias("t"))
    every = sizes.join(inside, "label", "left").join(across, "label", "left").join(kinds, "label", "left").join(topics, "label", "left")
    shared = F.col("k.less") * -10 >= F.col("members") * 7
    name = F.when(shared, F.col("k.kind")).otherwise(F.coalesce(F.array_join(F.col("t.topic"), ", "), F.col("label")))
    return every.select("label", "members", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("across", F.lit(0)).alias("across"), name.alias("name"))


def suffix_matches(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(corpus_id, path, target, found): the file that an import names, by equal path or path end.

    Each file offers all ends of its path without extension, so that ends meet
    by an equi-join; the shortest path wins, then the first by name.
    """
    plain = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = F.split(plain, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    offers = files.select("corpus_id", F.col("path").alias("found"), F.explode(ends).alias("end"))
    asked = wanted.withColumn("end", F.regexp_replace(F.regexp_replace("target", r"^[./]+", ""), r"\.", "/"))
    hits = asked.join(offers, ["corpus_id", "end"]).filter("found <> path")
    return hits.groupBy("corpus_id", "path", "target").agg(F.min_by("found", F.struct(F.length("found"), F.col("found"))).alias("found"))


def ranked_by(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
