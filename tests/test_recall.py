"""Recall gates: pairs meet as matrices in blocks, and only those that can be among the best leave a block."""

import random

import duckdb
import numpy as np
import pytest

from kelpline.operators import store_queries as Q


@pytest.fixture
def entries(spark, tmp_path):
    """Two corpora of more than a block each, with copies (ties), small steps and vectors whose first half is zero."""
    draw = random.Random(7)
    vector = lambda: [float(draw.choice((-1, 0, 1, 2))) for _ in range(64)]
    rows = []
    for i in range(1200):
        v = rows[draw.randrange(len(rows))][2] if rows and i % 3 == 0 else [0.0] * 32 + vector()[:32] if i % 101 == 0 else vector()
        rows.append((draw.choice("aab"), 1200 - i, v))
    rows += [("a", 5000, None), ("b", 5100, [0.0] * 64), (None, 5200, vector()), ("c", 5300, vector())]
    spark.createDataFrame(rows, "corpus_id string, entry_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embedding_entries.parquet")
    return str(tmp_path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view embedding_entries as select * from read_parquet('{folder}/embedding_entries.parquet/*.parquet')")
    got = {r.corpus_id: (r.queries, round(r.recall, 6), r.passed) for r in Q.QUERIES[name](spark, folder).collect()}
    return got == {c: (n, round(r, 6), p) for c, n, r, p in con.execute(f"select corpus_id, queries, recall, passed from ({Q.SQL[name]})").fetchall()} and len(got) == 2


def test_half_recall_in_blocks(spark, entries, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 128)
    monkeypatch.setattr(Q, "ASKED", 3)
    monkeypatch.setattr(Q, "SCORES", 200)
    assert same_as_sql(spark, entries, "vec_half_recall")
    assert Q._asked(spark, entries, "short", 10).count() <= 12 * 8 * 20  # queries, blocks, best of both; not all 7 000 pairs


def test_sign_recall_in_blocks(spark, entries, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 512)
    monkeypatch.setattr(Q, "ASKED", 5)
    assert same_as_sql(spark, entries, "vec_sign_recall")
    assert Q._asked(spark, entries, "signs", 20).count() <= 12 * 2 * 30  # queries, blocks, best of both; not all 7 000 pairs


def test_only_what_leaves_a_block_is_rounded(spark, entries, monkeypatch):
    """Of the pairs of a block few are among the best; the scores of the others are only compared."""
    seen, as_sql = spark.sparkContext.accumulator(0), Q.rounded

    def counted(s):
        seen.add(s.size)
        return as_sql(s)

    monkeypatch.setattr(Q, "rounded", counted)
    left = Q._asked(spark, entries, "signs", 20).collect()
    assert 0 < len(left) <= 12 * 30 and seen.value <= 2 * len(left)  # not twice all 7 000 pairs


def test_best_of_ties_and_odd_scores():
    """The k largest as rounded, ties to the first, NaN above all, own columns never."""
    draw = np.random.default_rng(5)
    with np.errstate(all="ignore"):
        for kind in range(400):
            s = draw.normal(size=(4, 50)).round(1) + draw.choice([0, 1e-7, -5e-7], size=(4, 50))
            if kind % 4 == 1:
                s[draw.random(s.shape) < 0.2] = draw.choice([np.nan, np.inf, -np.inf])
            if kind % 4 == 2:
                s *= draw.choice([1e9, 1e304, 0])
            k, own = int(draw.integers(1, 60)), [(a, a + int(draw.integers(0, 3))) for a in draw.integers(0, 48, 4)]
            r, wanted = Q.rounded(s), set()
            for row, (a, b) in enumerate(own):
                others = [c for c in range(50) if not a <= c < b]
                wanted |= {row * 50 + c for c in sorted(others, key=lambda c: (-r[row, c], c))[:k]}
            assert set(Q.best(s, k, own).tolist()) == wanted
