"""Choosing a varied subset by systematic selection along a Hilbert curve.

A unit vector is pseudo-rotated, its first `axes` coordinates are quantised to
`bits` bits each, and the place of that cell on the Hilbert curve is its key.
Cells that follow each other on the curve are close in space, but records that
are alike seldom share one. So a record that is alike to a better kept one of
its group is left out first, by exact cosine; the kept ones are sorted globally
by key and evenly spaced ones are chosen. A large group of near-equal records
keeps few and so takes few places. Lists that fit a row are sorted along several
curves, and only neighbours on one of them are compared.

Defined cases: rows with an unusable vector (see vectors.usable) or a null best
value are left out; of rows that tie as best the smallest id is chosen; repeated
rows count once; groups with fewer kept records than places give them all;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.neighbours import candidates, hashes_for, keyed, search_for
from kelpline.llm.vectors import matrix, pseudo_rotation, unit, usable
from kelpline.plans.ranks import with_global_rank
from kelpline.session import stored

AXES, BITS = 6, 4
CURVES, SEED = 6, 17  # curves on which the members of a list may become neighbours
ALIKE = 0.9


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of grid coordinates below 2**bits.

    By Skilling's transform of the coordinates (AIP Conf. Proc. 707, 2004), then
    the bits of all axes interleaved; axes * bits must stay below 63.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(v: np.ndarray, axes: int = AXES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Curve keys of unit vectors. A coordinate has about a normal law of deviation 1/sqrt(d); it is cut at two deviations."""
    r = pseudo_rotation(v, seed)[:, :axes]
    reach = 2 / np.sqrt(v.shape[1])
    cells = np.floor((np.clip(r, -reach, reach) + reach) / (2 * reach) * (1 << bits))
    return hilbert_key(np.minimum(cells, (1 << bits) - 1), bits)


def with_curve_key(df: DataFrame, vector_col: str, axes: int = AXES, bits: int = BITS) -> DataFrame:
    """df's usable rows with `key`."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[names].assign(key=curve_keys(unit(matrix(batch[vector_col])), axes, bits))

    return df.filter(usable(vector_col)).mapInPandas(run, df.select("*", F.lit(0).cast("bigint").alias("key")).schema)


def alike_edges(nodes: DataFrame, alike: float) -> DataFrame:
    """(better, worse) of each pair of nodes (grp, node, first, v) of one group alike by exact cosine; better has the smaller first.

    Candidates share a bucket of their group (see neighbours). All pairs are
    compared: quadratic in the size of a dense group, in tiles of bounded size.
    """
    hashes = hashes_for(nodes.count())
    tables, probes = search_for(hashes, alike)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = np.einsum("ij,ij->i", unit(matrix(batch["va"])), unit(matrix(batch["vb"])))
                yield batch.loc[np.round(s, 6) >= alike, ["better", "worse"]]

    asked = nodes.select(F.col("node").alias("class_id"), "v", F.lit(True).alias("asks"), F.xxhash64("grp").alias("salt"))
    near = candidates(stored(keyed(asked, tables, hashes, probes), "alike_keyed"), alike, 1).select("q", "b")
    side = lambda id, x: nodes.select(F.col("node").alias(id), F.col("grp").alias(f"grp_{x}"), F.col("first").alias(f"first_{x}"), F.col("v").alias(f"v{x}"))
    both = near.join(side("q", "a"), "q").join(side("b", "b"), "b").filter("grp_a = grp_b")
    order = lambda x, y: F.when(F.col("first_a") < F.col("first_b"), F.col(x)).otherwise(F.col(y))
    return both.select(order("q", "b").alias("better"), order("b", "q").alias("worse"), "va", "vb").mapInPandas(exact, "better bigint, worse bigint")


def without_alike(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of which none is alike to a better kept one, as if taken best first.

    In each round nodes without a better neighbour left are kept and their
    neighbours go; every edge is better to worse, so each round ends some.
    """
    edges = stored(edges, "alike_edges")
    while not edges.isEmpty():
        kept = edges.select(F.col("better").alias("node")).distinct().join(edges.select(F.col("worse").alias("node")).distinct(), "node", "left_anti")
        gone = stored(edges.join(kept.withColumnRenamed("node", "better"), "better", "left_semi").select(F.col("worse").alias("node")).distinct(), "alike_gone")
        nodes = nodes.join(gone, "node", "left_anti")
        edges = stored(edges.join(gone.withColumnRenamed("node", "better"), "better", "left_anti").join(gone.withColumnRenamed("node", "worse"), "worse", "left_anti"), "alike_edges")
    return nodes


def varied_subset(df: DataFrame, group_col: str, id_col: str, best_col: str, vector_col: str, size: int, axes: int = AXES, bits: int = BITS, alike: float = ALIKE) -> DataFrame:
    """(group, id, key): `size` records of each group, evenly spaced along the curve over those that are not alike to a better one.

    Groups may be of any size: equal vectors are reduced with map-side combine,
    the kept records are ranked by a global sort over all groups, and the places
    follow from the rank within the group; no group meets in one task.
    """
    rows = df.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(best_col).alias("best"), F.col(vector_col).alias("v")).filter("grp is not null and id is not null and best is not null")
    nodes = rows.filter(usable("v")).withColumn("v", F.col("v").cast("array<double>")).groupBy("grp", "v").agg(F.min(F.struct("best", "id")).alias("first")).withColumn("node", F.xxhash64("grp", "v"))
    nodes = stored(nodes.withColumn("first", F.struct("first.best", "first.id", "node")), "alike_nodes")
    kept = with_curve_key(without_alike(nodes, alike_edges(nodes, alike)), "v", axes, bits)
    ranked = with_global_rank(kept.select("grp", "key", F.col("first.id").alias("id")), ["grp", "key", "id"])
    groups = ranked.groupBy("grp").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("kept"))
    at = F.col("rank") - F.col("start")
    step = lambda i: F.floor(i * F.lit(size) / F.col("kept"))
    return ranked.join(groups, "grp").filter(step(at + 1) > step(at)).select("grp", "id", "key")


def curve_cells(v: np.ndarray, keys: np.ndarray, alike: float) -> list[int]:
    """The best (first) record of each cell; v and the rows of keys (one column per curve) come best first.

    Along each curve only neighbours are compared: alike ones are one cell.
    """
    best = np.arange(len(v))

    def top(i: int) -> int:
        while best[i] != i:
            best[i] = best[best[i]]
            i = best[i]
        return i

    for curve in range(keys.shape[1]):
        order = np.argsort(keys[:, curve], kind="stable")
        near = np.round(np.einsum("ij,ij->i", v[order[:-1]], v[order[1:]]), 6) >= alike
        for i, j in zip(order[:-1][near].tolist(), order[1:][near].tolist()):
            i, j = top(i), top(j)
            best[max(i, j)] = min(i, j)
    return [i for i in range(len(v)) if best[i] == i]


def varied_of_lists(lists: DataFrame, size_col: str, members_col: str, alike: float = ALIKE, axes: int = AXES, bits: int = BITS, curves: int = CURVES) -> DataFrame:
    """For lists that each fit a row: `chosen`, the names chosen of each list.

    members: array<struct<place, name, v>>, one list's usable members. They are
    sorted by their keys on `curves` Hilbert curves of differently rotated
    space. Neighbours on a curve that are alike by exact cosine share a cell;
    records that no curve brings together do not meet. Then `size` evenly
    spaced cells along the first curve are chosen and the best (first) record
    of each. A null size chooses nothing. The length of a list is that of one
    row's array, and the work grows with it as a sort does.
    """
    names = [c for c in lists.columns if c != members_col]
    schema = lists.select(*names, F.array(F.lit("")).alias("chosen")).schema

    def one(size: int, members: list, v: np.ndarray, keys: np.ndarray) -> list[str]:
        cells = sorted(curve_cells(v, keys, alike), key=lambda i: (keys[i, 0], i))
        n, size = len(cells), max(0, size)
        if n > size:
            cells = [i for at, i in enumerate(cells) if (at + 1) * size // n > at * size // n]
        return [members[i]["name"] for i in sorted(cells)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                listed = [sorted(m, key=lambda m: m["place"]) for m in part[members_col]]
                ends = np.cumsum([0, *map(len, listed)])
                v = unit(np.stack([m["v"] for ms in listed for m in ms])) if ends[-1] else np.zeros((0, 1))
                keys = np.stack([curve_keys(v, axes, bits, SEED + c) for c in range(curves)], axis=1) if ends[-1] else np.zeros((0, curves))
                chosen = [one(0 if pd.isna(s) else int(s), ms, v[i:j], keys[i:j]) for s, ms, i, j in zip(part[size_col], listed, ends, ends[1:])]
                yield part[names].assign(chosen=chosen)

    return lists.mapInPandas(run, schema)


def runs_with_members(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """(run_id, top_k, members) of the mmr runs without error; members by file, first place of each.

    Complete duplicates of a run count once; null run_ids are left out. A file with several usable
    entries has equal ones; the smallest entry_id stands for it.
    """
    files = entries.filter(usable("embedding")).groupBy("corpus_id", "file_id").agg(F.min_by("embedding", "entry_id").alias("v"))
    asked = runs.filter("rerank = 'mmr' and error is null and run_id is not null").dropDuplicates(["run_id"])
    listed = asked.select("run_id", "corpus_id", "top_k", F.posexplode("retrieved").alias("place", "file_id")).filter("file_id is not null")
    listed = listed.groupBy("run_id", "corpus_id", "top_k", "file_id").agg(F.min("place").alias("place"))
    found = listed.join(files, ["corpus_id", "file_id"])
    return found.groupBy("run_id", "top_k").agg(F.collect_list(F.struct("place", F.col("file_id").alias("name"), "v")).alias("members"))
