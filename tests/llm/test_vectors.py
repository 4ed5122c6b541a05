import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import neighbours as N
from kelpline.llm import subset as S
from kelpline.llm.vectors import hadamard, pseudo_rotation

SCHEMA = "entry_id bigint, embedding array<double>, id string, v int, key string, q int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, "clash", 2) for i, v in rows], SCHEMA)


def brute(rows, k, floor):
    rows = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 64 and not any(x is None or np.isnan(x) or np.isinf(x) for x in v) and any(v)}
    out = set()
    for i, v in rows.items():
        s = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w in rows.items() if j != i)[:k]
        out |= {(i, j, -c) for c, j in s if -c >= floor}
    return out


def planted(seed=1, groups=12, size=9):
    rng = np.random.default_rng(seed)
    rows, i = [], 1
    for _ in range(groups):
        centre = rng.normal(size=64)
        for _ in range(size):
            rows.append((i, list(map(float, centre + 0.15 * rng.normal(size=64)))))
            i += 1
    rows += [(1000 + j, rows[0][1]) for j in range(15)]  # copies of one vector
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [0.0] * 64), (2004, [float("nan")] + [1.0] * 63), (2005, [None] + [1.0] * 63), (2006, [float("inf")] + [1.0] * 63), (5, rows[4][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize("tile", [2048, 3])
def test_pairs_above_the_floor_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)  # 3: every bucket is cut into tiles
    rows = planted()
    got = {(r.id, r.neighbour, r.similarity) for r in N.similar_vectors(frame(spark, rows), "entry_id", "embedding", k=10, floor=0.9).collect()}
    assert got == brute(rows, 10, 0.9)


def test_recall_without_floor(spark):
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, rng.normal(size=64)))) for i in range(1, 1500)]
    got = {(r.id, r.neighbour) for r in N.similar_vectors(frame(spark, rows), "entry_id", "embedding", k=10, asking="entry_id % 100 = 0").collect()}
    want = {(i, j) for i, j, _ in brute(rows, 10, -1) if i % 100 == 0}
    assert len(got & want) / len(want) >= 0.9 and {i for i, _ in got} == {i for i, _ in want}


@pytest.mark.parametrize("tile", [2048, 50])
def test_dense_groups_without_floor_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rng = np.random.default_rng(4)
    centre, other = rng.normal(size=(2, 64))
    rows = [(i, list(map(float, centre * s))) for i, s in zip(rng.permutation(200).tolist(), rng.uniform(0.1, 9, 200))]  # cosine 1: the smallest ids
    rows += [(1000 + i, list(map(float, other + 0.001 * rng.normal(size=64)))) for i in range(200)]  # nearer than 8 bits tell
    got = {(r.id, r.neighbour, r.similarity) for r in N.similar_vectors(frame(spark, rows), "entry_id", "embedding", k=10, tables=4, probes=4, hashes=1).collect()}
    assert got == brute(rows, 10, -1)


def test_recall_holds_with_three_hashes(spark):
    rng = np.random.default_rng(6)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 400, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(2 * i + j, list(map(float, x))) for i in range(400) for j, x in enumerate((a[i], b[i]))]
    got = {(r.id, r.neighbour) for r in N.similar_vectors(frame(spark, rows), "entry_id", "embedding", k=10, floor=0.9, hashes=3).collect()}
    assert got == {(j, i) for i, j in got} and len(got) >= 0.985 * 800


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e3])
def test_rounded_copies_know_how_far_they_are_off(scale):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 64)) * scale
    x[:64] = np.eye(64) + 0.002 * rng.normal(size=(64, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, off = N.restored([c.tobytes() for c in N.rounded(x)])
    assert (np.abs(x @ x.T - y @ y.T) <= off[:, None] + off[None, :]).all() and off.max() < 0.02


def test_no_vectors(spark):
    assert N.similar_vectors(frame(spark, []), "entry_id", "embedding").count() == 0
    assert N.similar_vectors(frame(spark, [(1, None), (2, [1.0] * 64)]), "entry_id", "embedding").count() == 0


def test_rotation_keeps_angles():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(hadamard(hadamard(x)), x)
    assert np.allclose(pseudo_rotation(x, 4) @ pseudo_rotation(x, 4).T, x @ x.T)
    assert pseudo_rotation(np.ones((2, 5)), 1).shape == (2, 8)


@pytest.mark.parametrize("axes, bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_steps_to_a_neighbour(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = S.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_subset_of_lists_takes_one_of_each_group(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 64))
    vector = lambda g: list(map(float, centres[g] + 0.1 * rng.normal(size=64)))
    order = [3, 3, 0, 3, 1, 0, 4, 3, 2, 1, 3, 3]
    members = [{"place": i, "name": f"f{i}", "v": vector(g)} for i, g in enumerate(order)]
    schema = "run_id bigint, top_k int, members array<struct<place:int,name:string,v:array<double>>>"
    lists = spark.createDataFrame([(1, 5, members), (2, 2, members), (3, 9, members[:1]), (4, 3, []), (5, None, members)], schema)
    got = {r.run_id: r.chosen for r in S.varied_of_lists(lists, "top_k", "members").collect()}
    assert got[1] == ["f0", "f2", "f4", "f6", "f8"]
    assert len(got[2]) == 2 and set(got[2]) < set(got[1]) and got[3] == ["f0"] and got[4] == got[5] == []


def test_the_curves_decide_which_members_meet(monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 64))
    group = rng.permutation(np.repeat(np.arange(12), 5))
    v = centres[group] + 0.1 * rng.normal(size=(60, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    keys = np.stack([S.curve_keys(v, seed=S.SEED + c) for c in range(S.CURVES)], axis=1)
    first = [int(np.flatnonzero(group == g)[0]) for g in range(12)]
    assert S.curve_cells(v, keys, 0.9) == sorted(first)
    assert len(S.curve_cells(v, rng.permutation(keys), 0.9)) > 12  # without the order of the curve alike members do not meet


def test_subset_of_groups_is_spread(spark):
    rng = np.random.default_rng(5)
    big = list(map(float, rng.normal(size=64)))
    rows = [(i, big) for i in range(300)] + [(1000 + i, list(map(float, rng.normal(size=64)))) for i in range(100)]
    df = frame(spark, rows).withColumn("corpus", F.lit("c")).withColumn("best", F.col("entry_id"))
    got = S.varied_subset(df.unionByName(df), "corpus", "entry_id", "best", "embedding", 20).collect()
    assert len(got) == 20 and sum(r.id < 1000 for r in got) <= 1
    assert S.varied_subset(df.limit(0), "corpus", "entry_id", "best", "embedding", 20).count() == 0


def test_noisy_group_takes_few_places(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    rows = [(i, list(map(float, centre + 0.2 * rng.normal(size=64)))) for i in range(150)] + [(1000 + i, list(map(float, rng.normal(size=64)))) for i in range(150)]
    df = frame(spark, rows).withColumn("corpus", F.lit("c")).withColumn("best", F.col("entry_id"))
    ids = {r.id for r in S.varied_subset(df, "corpus", "entry_id", "best", "embedding", 20).collect()}
    assert len(ids) == 20 and sum(i < 1000 for i in ids) <= 1
    kept = {r.id for r in S.varied_subset(df, "corpus", "entry_id", "best", "embedding", 1000).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = []
    for i in sorted(x):
        if all(round(float(x[i] @ x[j]), 6) < 0.9 for j in want):
            want.append(i)
    assert kept == set(want)
