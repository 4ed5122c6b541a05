"""Most similar vectors for every vector, by cross-polytope hashing.

Unit vectors pass through fast Hadamard pseudo-rotations; the nearest signed
axis is a hash, `hashes` of them make the key of a table. Each vector stands
in its own bucket of every table and probes the next best buckets as well.
Buckets give candidates by copies of 8 bits a number, scaled to each vector's
largest one, of which it is known how far they are off. Every candidate that,
within that, may reach the floor or be among the k best is ranked again by the
exact cosine of the full vectors. However many there are, none is cut before that.

Copies of one vector are one class while searching: only their k + 1 smallest
ids can be in a list of the k best, so nothing is lost. A bucket with many
distinct vectors is cut into tiles of bounded size that meet pairwise in
separate tasks, so no task holds a whole bucket and no pair is dropped.

Defined cases: vectors that are null, of another length, with null, NaN or
infinite numbers, or all zero, and rows with a null id are left out; ties go to the smaller id; repeated
rows of one id count once, with one of its vectors; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.vectors import DIMS, matrix, pseudo_rotation, unit, usable
from kelpline.session import stored

TILE = 2048
#: Without a floor, the cosine and the share of pairs of that cosine that tables and probes are chosen for.
FAR, FAR_SHARE = 0.4, 0.99


def rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of bytes: the step, how far the cosine of two copies may be off by this one, and a byte for each number.

    With e the error of a copy, a cosine is off by |e| + |f| + 3 |e| |f| at most.
    """
    step = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
    code = np.rint(x / step).astype(np.int8)
    off = np.linalg.norm(x - code * step, axis=1, keepdims=True)
    head = np.concatenate([step, (off + 1.5 * off * off + 1e-5).astype(np.float32)], axis=1)
    return np.concatenate([head.view(np.int8), code], axis=1)


def restored(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, how far each may be off) of the rows of `rounded`."""
    raw = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:] * head[:, :1], head[:, 1]


def hashes_for(rows: int, bucket: int = 64, dims: int = DIMS) -> int:
    """Hashes per key so that a bucket of unrelated vectors holds about `bucket` or fewer."""
    return max(1, math.ceil(math.log(max(rows, 2) / bucket) / math.log(2 * dims)))


@functools.cache
def _choices(tops: int, hashes: int, probes: int) -> np.ndarray:
    """Which of its best axes each hash takes, of all that can be among the `probes` best buckets: one row each."""
    choices: list[tuple[int, ...]] = [()]
    for _ in range(hashes):
        choices = [(*c, i) for c in choices for i in range(min(tops, probes // math.prod(j + 1 for j in c)))]
    return np.array(choices)


def probe_keys(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """The keys of the `probes` best buckets of each row in one table, the own bucket first."""
    tops = max(2, min(probes, 2 * x.shape[1]))
    choices = _choices(tops, hashes, probes)
    cost, keys = np.zeros((len(x), len(choices))), np.zeros((len(x), len(choices)), np.int64)
    for h in range(hashes):
        r = pseudo_rotation(x, 7919 * table + h)
        d = r.shape[1]
        signed = np.concatenate([r, -r], axis=1)
        best = np.argpartition(-signed, min(tops, 2 * d - 1), axis=1)[:, :tops]
        score = np.take_along_axis(signed, best, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        cost += ((score[:, :1] - score) ** 2)[:, choices[:, h]]
        keys += (best.astype(np.int64) * (2 * d) ** h)[:, choices[:, h]]
    return np.take_along_axis(keys, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1)


@functools.cache
def search_for(hashes: int, floor: float | None, both: bool = True, most: int = 64) -> tuple[int, int]:
    """(tables, probes) by which 995 of 1000 pairs at the floor are found with keys of so many hashes.

    Without a floor, FAR_SHARE of the pairs of cosine FAR. A pair is found when
    either side probes the other's bucket, or, unless both sides ask, when the
    first does. Counted on drawn pairs, because longer keys part more pairs; a
    floor out of reach of `most` tables gets those.
    """
    least, share = (6, 0.995) if floor is not None else (4, FAR_SHARE)
    probes = 4 << max(0, hashes - 2) if floor is not None else min(8**hashes, 256)
    at = FAR if floor is None else floor
    rng = np.random.default_rng(11)
    a, b = (unit(x) for x in rng.normal(size=(2, 1000 if hashes < 3 or both else 250, DIMS)))
    b = at * a + math.sqrt(max(0.0, 1 - at * at)) * unit(b - (a * b).sum(1, keepdims=True) * a)
    found = np.zeros(len(a), bool)
    for t in range(most):
        keys_a, keys_b = probe_keys(a, t, hashes, probes), probe_keys(b, t, hashes, probes if both else 1)
        found |= (keys_a == keys_b[:, :1]).any(axis=1)
        if both:
            found |= (keys_b == keys_a[:, :1]).any(axis=1)
        if t + 1 >= least and found.mean() >= share:
            break
    return t + 1, probes


def keyed(vectors: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """vectors (class_id, v, asks, salt) with `code`, `own` (the bucket of each table) and `more` (those that it probes besides, if it asks).

    Rows of another salt have other buckets. Hashed once; what follows repeats only codes and keys.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                x = unit(matrix(part["v"]))
                asks = part["asks"].to_numpy(bool)
                own = np.zeros((len(x), tables), np.int64)
                more = []
                for t in range(tables):
                    keys = probe_keys(x, t, hashes, probes if asks.all() else 1)
                    own[:, t] = keys[:, 0] * tables + t
                    further = keys if asks.all() else probe_keys(x[asks], t, hashes, probes)
                    more.append(further[:, 1:] * tables + t)
                salt = part["salt"].to_numpy()
                probed: list = [np.zeros(0, np.int64)] * len(x)
                for i, keys in zip(np.flatnonzero(asks).tolist(), np.concatenate(more, axis=1)):
                    probed[i] = keys ^ salt[i]
                yield part.assign(code=[c.tobytes() for c in rounded(x)], own=list(own ^ salt[:, None]), more=probed)

    return vectors.mapInPandas(run, "class_id bigint, v array<double>, asks boolean, salt bigint, code binary, own array<bigint>, more array<bigint>")


LEFT, RIGHT, BOTH = 0, 1, 2


def _close_pairs(floor: float | None, k: int):
    """Candidates of each bucket tile, read as runs of sorted (bucket, tile_a, tile_b).

    With a floor, (q, b) with q < b of all that may reach it, whichever asked.
    Without, (q, b) of all that may be among the k best of q in the tile.
    """

    def of(left, right):
        ia, ib = left[0], right[0]
        (xa, ra), (xb, rb) = restored(left[1]), restored(right[1])
        s = xa @ xb.T
        off = ra[:, None] + rb[None, :]
        itself = ia[:, None] == ib[None, :]
        if floor is not None:
            p, q = np.nonzero((s + off >= floor) & ~itself)
            return np.minimum(ia[p], ib[q]), np.maximum(ia[p], ib[q]), (s + off)[p, q], (s - off)[p, q]
        low = np.where(itself, -3, s - off)
        n = min(k, s.shape[1])
        kth = np.partition(low, -n, axis=1)[:, -n]
        p, q = np.nonzero((s + off >= kth[:, None]) & ~itself)
        return ia[p], ib[q], (s + off)[p, q], low[p, q]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, out, n = None, [], 0
        frame = lambda: pd.DataFrame({k: np.concatenate(x) for k, x in zip(("q", "b", "high", "low"), zip(*out))})
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                now, done = kept, True
            else:
                if not len(batch):
                    continue
                now, done = (batch[["bucket", "tile_a", "tile_b"]].to_numpy(), batch["id"].to_numpy(), batch["side"].to_numpy(), batch["code"].to_numpy()), False
                if kept is not None:
                    now = tuple(np.concatenate(x) for x in zip(kept, now))
            if now is None:
                break
            cells, ids, side, codes = now
            starts = np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1, [len(cells)] * done]).astype(int)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                lefts, rights = side[s:e] != RIGHT, side[s:e] != LEFT
                if e - s > 1 and lefts.any() and rights.any():
                    got = of((ids[s:e][lefts], codes[s:e][lefts]), (ids[s:e][rights], codes[s:e][rights]))
                    if len(got[0]):
                        out.append(got)
                        n += len(got[0])
                        if n > 50_000:
                            yield frame()
                            out, n = [], 0
            kept = tuple(x[starts[-1] :] for x in now)
        if out:
            yield frame()

    return run


PAIRS = "q bigint, b bigint, high float, low float"


def candidates(vectors: DataFrame, floor: float | None, k: int) -> DataFrame:
    """(q, b, high, low), distinct pairs of stored `keyed` vectors that the tables bring together, with bounds of their cosine.

    A vector stands in its own buckets, and asks there and in those it probes.
    Buckets of at most TILE rows are one tile, in which a row that asks and
    answers stands once. Larger ones are cut by a hash of the id into n tiles;
    a row asks in n cells as the left and answers in n as the right. Only large
    buckets' counts come back as a join side.
    """
    sizes = vectors.select(F.explode("own").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    large = stored(sizes.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "large_buckets")
    stands = F.transform("own", lambda b: F.struct(b.alias("bucket"), F.when(F.col("asks"), BOTH).otherwise(RIGHT).alias("side")))
    probes = F.transform("more", lambda b: F.struct(b.alias("bucket"), F.lit(LEFT).alias("side")))
    rows = vectors.select(F.explode(F.concat(stands, probes)).alias("c"), F.col("class_id").alias("id"), "code").select("c.bucket", "c.side", "id", "code")
    if large.isEmpty():
        at = rows.withColumn("tile_a", F.lit(0)).withColumn("tile_b", F.lit(0)).repartition("bucket").sortWithinPartitions("bucket")
    else:
        rows = rows.join(large, "bucket", "left")
        own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        each = F.sequence(F.lit(0), F.col("tiles") - 1)
        cell = lambda a, b, side: F.struct(a.alias("tile_a"), b.alias("tile_b"), side.alias("side"))
        none = F.filter(F.array(cell(F.lit(0), F.lit(0), F.lit(LEFT))), lambda _: F.lit(False))
        asking = F.when(F.col("side") != RIGHT, F.transform(each, lambda t: cell(own, t, F.lit(LEFT)))).otherwise(none)
        answering = F.when(F.col("side") != LEFT, F.transform(each, lambda t: cell(t, own, F.lit(RIGHT)))).otherwise(none)
        cells = F.when(F.col("tiles").isNull(), F.array(cell(F.lit(0), F.lit(0), F.col("side")))).otherwise(F.concat(asking, answering))
        at = rows.select("bucket", F.explode(cells).alias("c"), "id", "code").select("bucket", "c.*", "id", "code")
        at = at.repartition("bucket", "tile_a", "tile_b").sortWithinPartitions("bucket", "tile_a", "tile_b")
    return at.mapInPandas(_close_pairs(floor, k), PAIRS).groupBy("q", "b").agg(F.max("high").alias("high"), F.min("low").alias("low"))


def similar_vectors(entries: DataFrame, id_col: str, vector_col: str, k: int = 10, floor: float | None = None, tables: int | None = None, probes: int | None = None, hashes: int | None = None, asking: str = "true") -> DataFrame:
    """(id, neighbour, similarity, place): the k most similar rows of each row that satisfies `asking`.

    similarity is the cosine rounded to 6 decimals; with floor only neighbours
    of at least that similarity come out. hashes: per key; by default from the
    number of rows. More tables and probes cost time and miss less; by default
    they follow from the hashes, so that recall holds at every size.

    Of the vectors themselves only what must meet moves: rows and classes are
    told apart by two hashes of the vector, 96 bits together.
    """
    rows = entries.filter(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.expr(asking).alias("ask")).filter("id is not null")
    rows = stored(rows.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"))), "vectors")
    ids = rows.groupBy("id").agg(F.min("h").alias("h"), F.max("ask").alias("ask"))
    first = ids.withColumn("_r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).filter(F.col("_r") <= k + 1)
    first = first.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("first_ids")).join(ids.groupBy("h").agg(F.max("ask").alias("asks")), "h")
    classes = stored(first.select(F.col("first_ids")[0].alias("class_id"), "first_ids", "asks", "h"), "classes")
    vectors = rows.join(classes.select(F.col("class_id").alias("id"), "h", "asks"), ["id", "h"]).groupBy("id", "asks").agg(F.first("v").alias("v"))
    hashes = hashes or hashes_for(classes.count())
    by_default = search_for(hashes, floor, asking == "true")
    vectors = vectors.select(F.col("id").alias("class_id"), "v", "asks", F.lit(0).cast("bigint").alias("salt"))
    vectors = stored(keyed(vectors, tables or by_default[0], hashes, probes or by_default[1]), "class_vectors")
    near = candidates(vectors, floor, k)
    if floor is None:  # those that may be among the k best
        w = Window.partitionBy("q").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        near = near.withColumn("_kth", F.coalesce(F.nth_value("low", k).over(w), F.lit(-3.0))).filter(F.col("high") >= F.col("_kth"))

    side = lambda id, v: vectors.select(F.col("class_id").alias(id), F.col("v").alias(v))
    exact = near.select("q", "b").join(side("q", "va"), "q").join(side("b", "vb"), "b").mapInPandas(_cosines, "q bigint, b bigint, similarity double")
    if floor is not None:
        exact = exact.filter(F.col("similarity") >= floor)
        exact = exact.select(F.explode(F.array(F.struct("q", "b", "similarity"), F.struct(F.col("b").alias("q"), F.col("q").alias("b"), "similarity"))).alias("p")).select("p.*")
    exact = exact.join(classes.select(F.col("class_id").alias("b"), F.col("first_ids").alias("ids")), "b").select("q", "similarity", "ids")
    own = classes.filter("asks").select(F.col("class_id").alias("q"), F.lit(1.0).alias("similarity"), F.col("first_ids").alias("ids"))
    offers = exact.unionByName(own).select("q", "similarity", F.explode("ids").alias("neighbour"))
    best = offers.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "neighbour"))).filter(F.col("_r") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "neighbour", "similarity"))).alias("best"))

    # a class of many copies: its rows meet one row of at most k + 1 neighbours
    of = ids.filter("ask").join(classes.select("h", F.col("class_id").alias("q")), "h").select("id", "q").join(lists, "q")
    others = F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return of.select("id", F.posexplode(others).alias("place", "n")).select("id", "n.neighbour", "n.similarity", F.col("place") + 1).toDF("id", "neighbour", "similarity", "place")


def _cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            s = np.einsum("ij,ij->i", unit(matrix(batch["va"])), unit(matrix(batch["vb"])))
            yield pd.DataFrame({"q": batch["q"], "b": batch["b"], "similarity": np.round(np.clip(s, -1, 1), 6)})
