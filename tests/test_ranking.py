import pytest

from kelpline.operators import files as X
from kelpline.operators import ranking as K
from kelpline.operators import store_queries as Q
from kelpline.operators import structure as S
from kelpline.plans.joins import small
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "path, heads, want",
    [("spec/guideline.md", "", "framework"), ("src/a.py", "", "ground_truth"), ("README.md", "", "artifact"), ("x.bin", "", "artifact"), ("docs/x.md", "", "evidence"), ("todo.md", "", "hypothesis"), ("a.md", "Meeting  notes", "signal"), ("docs/x.md", "How to; best practice", "framework"), ("features.MD", "", "evidence"), ("data.csv", "", "artifact")],
)
def test_classes(spark, path, heads, want):
    assert spark.range(1).select(X.file_class(F.lit(path), F.lit(heads)).alias("c")).first().c == want


def test_query_kinds(spark):
    rows = spark.createDataFrame([("Compare the what is of A and B",), ("short one",), ("where is " + "x" * 60,), ("tell everything about this long winded and open subject, please",), (None,)], "q string")
    assert [r.k for r in rows.select(K.query_kind(F.col("q")).alias("k")).collect()] == ["analytical", "factual", "factual", "exploratory", "factual"]
    assert X.topic_terms("what is the vessel and un signal") == ["vessel", "signal"]


def members(spark, rows, weight, top):
    return spark.createDataFrame([(1, "c", top, weight, i, f, r, v) for i, (f, r, v) in enumerate(rows)], "run_id bigint, corpus_id string, top_k int, weight double, place int, file_id string, relevance double, v array<double>")


def test_diversified_leaves_the_lookalike(spark):
    rows = [("a", 0.9, [1.0, 0.0]), ("b", 0.88, [0.999, 0.04]), ("c", 0.5, [0.0, 1.0])]
    pick = lambda weight, top: [r.file_id for r in sorted(K.diversified(members(spark, rows, weight, top)).collect(), key=lambda r: r.place)]
    assert pick(0.5, 2) == ["a", "c"] and pick(1.0, 2) == ["a", "b"] and pick(0.5, 9) == ["a", "c", "b"]
    assert K.diversified(members(spark, rows, 0.5, 2).limit(0)).count() == 0


def test_diversity_is_one_less_the_mean_cosine(spark):
    rows = [("a", 0.0, [2.0, 0.0]), ("b", 0.0, [0.0, 3.0]), ("c", 0.0, [1.0, 0.0])]
    assert K.diversity(members(spark, rows, 0.5, 2), "run_id").first().diversity == round(1 - 1 / 3, 5)
    assert K.diversity(members(spark, rows[:1], 0.5, 2), "run_id").first().diversity == 1.0


def test_fused_ranks(spark):
    keyword = spark.createDataFrame([("c", "both", 0.5), ("c", "word", 0.5), ("c", "weak", 0.09)], "g string, p string, relevance double")
    semantic = spark.createDataFrame([("c", "near", 0.9), ("c", "both", 0.2), ("c", "far", 0.14)], "g string, p string, similarity double")
    got = sorted(K.fused_ranks(keyword, semantic, "g", "p", 9).collect(), key=lambda r: r.place)
    assert [(r.p, r.confidence, r.reason) for r in got] == [("near", 0.9, "semantic"), ("both", 0.5, "both"), ("word", 0.5, "keyword")]


def test_search_keeps_the_floor_and_splits_hot_groups(spark):
    entries = spark.createDataFrame([("g", i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)] + [("h", 99, [1.0, 0.0])], "g string, entry_id bigint, u array<double>")
    asked = spark.createDataFrame([("q", "g", [2.0, 0.0]), ("z", "g", [0.0, 0.0])], "t string, g string, q array<double>")
    assert [(r.t, r.entry_id, r.place) for r in K.search(entries, asked, "t", "g", 3).orderBy("place").collect()] == [("q", 1, 1), ("q", 3, 2), ("q", 5, 3)]


def test_quota_takes_turns(spark):
    found = spark.createDataFrame([("a", "1", 0.9, 50), ("a", "2", 0.8, 50), ("b", "3", 0.1, 50), ("b", "4", 0.05, 50)], "g string, path string, relevance double, tokens bigint")
    assert [r.path for r in K.merged_with_quota(found, "g", 150, 5).orderBy("used").collect()] == ["1", "3", "2"]


def pack_by_hand(items, budget):
    cost = lambda i, d: max(5, int(i[1] * Q.DEPTHS[d] + 1e-9))
    got = [[i, i[2]] for i in items]
    total = lambda: sum(cost(i, d) for i, d in got)
    while total() > budget and any(d < 4 for _, d in got):
        last = max(k for k, (_, d) in enumerate(got) if d < 4)
        got[last][1] += 1
    while total() > budget and len(got) > 1:
        got.pop()
    for g in got:
        while g[1] > 0 and total() - cost(g[0], g[1]) + cost(g[0], g[1] - 1) <= budget:
            g[1] -= 1
    return [(i[0], d, cost(i, d)) for i, d in got]


@pytest.mark.parametrize("budget", [1, 30, 60, 130, 240, 420, 900, 5000])
def test_packing_by_depth_by_brute_force(spark, budget):
    items = [(f"e{k}", (k * 53) % 170 + 20, 0 if k < 6 else 2) for k in range(12)]
    rows = spark.createDataFrame([(i, 0, k + 1, t, s) for k, (i, t, s) in enumerate(items)], "id string, via int, rank int, tokens bigint, start int")
    got = {r.id: (r.depth, r.cost) for r in Q.packed_by_depth(rows, budget).collect()}
    assert got == {i: (d, c) for i, d, c in pack_by_hand(items, budget)}


def test_heading_tree(spark):
    h = [(1, "A", 10), (2, "B", 5), (3, "C", 2), (2, "D", 1), (1, "E", 7)]
    files = spark.createDataFrame([("c", "p", [dict(zip(("depth", "title", "tokens"), x)) for x in h]), ("c", "q", []), ("c", "r", None)], "corpus_id string, path string, headings array<struct<depth:int,title:string,tokens:int>>")
    got = {r.title: (r.parent, r.total) for r in S.heading_tree(files).collect()}
    assert got == {"A": (-1, 18), "B": (0, 7), "C": (1, 2), "D": (0, 1), "E": (-1, 7)}


def test_symbols_and_links(spark):
    code = "class A:\n    def f(self):\n        return 1\n\n    x = 2\n\n\ndef g():\n    return 2\n"
    paths = ["src/user.py", "tests/test_user.py", "docs/user-guide.md", "src/ab.py", "docs/ab.md", "docs/cab.md"]
    files = S.with_roles(spark.createDataFrame([("c", p, code if p == "src/user.py" else None) for p in paths], "corpus_id string, path string, content string"))
    symbols = S.symbol_lines(files)
    assert {(r.name, r.first, r.last) for r in symbols.collect()} == {("A", 1, 7), ("f", 2, 4), ("g", 8, 9)}
    lines = spark.createDataFrame([("c", "src/user.py", n) for n in (3, 5, 9)], "corpus_id string, path string, line int")
    assert {(r.line, r.name) for r in S.innermost(symbols, lines).collect()} == {(3, "f"), (5, "A"), (9, "g")}
    assert {(r.source, r.target, r.kind) for r in S.test_links(files).collect()} == {("tests/test_user.py", "src/user.py", "tests"), ("src/user.py", "tests/test_user.py", "tested_by")}
    assert {(r.source, r.target) for r in S.doc_links(files).collect()} == {("docs/user-guide.md", "src/user.py"), ("docs/ab.md", "src/ab.py"), ("docs/cab.md", "src/ab.py")}
    assert {(r.source, r.target) for r in S.doc_links(files, 4).collect()} == {("docs/user-guide.md", "src/user.py"), ("docs/ab.md", "src/ab.py")}


def test_small_counts_rows_and_characters(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert small(df, 10) and not small(df, 9) and not small(df, 10, 500) and small(df.limit(0), 0)
