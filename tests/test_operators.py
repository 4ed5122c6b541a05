import math

from kelpline.operators import entities as E
from kelpline.operators import files as X
from kelpline.operators import graph as G
from kelpline.operators import ranking as K
from kelpline.operators import retrieval as R
from kelpline.functions import text as T
from pyspark.sql import functions as F


def test_stems_and_tokens(spark):
    assert [T.stem(w) for w in ("normalization", "indexing", "vessels", "news")] == ["norm", "index", "vessel", "news"]
    got = spark.sql(f"select {T.stem_sql('w')} as s from values ('normalization'), ('indexing'), ('vessels'), ('news') as t(w)")
    assert sorted(r.s for r in got.collect()) == sorted(["norm", "index", "vessel", "news"])
    rows = spark.createDataFrame([("",), (None,), ("a",), ("x" * 40,), ("```" + "y" * 19 + "```",)], "t string").select(T.estimated_tokens(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [0, 0, 1, 10, 10]


def test_headings_refs_slugs(spark):
    row = spark.createDataFrame([("# One\ntext\r\n### Three  \n#no\n[[a-b#c|d]] [[e]]",)], "t string").select(T.headings(F.col("t")).alias("h"), T.wikirefs(F.col("t")).alias("r"), T.slug(F.lit("  Ab, c! ")).alias("s"), T.slug(F.lit("!")).alias("u")).first()
    assert [(h.line, h.depth, h.title) for h in row.h] == [(0, 1, "One"), (2, 3, "Three")]
    assert [(r.target, r.anchor, r.shown) for r in row.r] == [("a-b", "c", "d"), ("e", None, None)]
    assert (row.s, row.u) == ("ab-c", "untitled")


def pack_by_hand(budget, items):
    files = sorted((-r, t, p) for r, t, p in items)
    cost = lambda t, d: max(5, int(t * (1.0 if d == 0 else 0.03)))
    got = [[p, 0 if -r >= 0.4 else 4, t] for r, t, p in files]
    total = lambda: sum(cost(t, d) for _, d, t in got)
    for g in reversed(got):
        if total() > budget and g[1] == 0:
            g[1] = 4
    while got and total() > budget:
        got.pop()
    if total() < budget * 0.92:
        for g in got:
            if total() >= budget * 0.95:
                break
            if g[1] == 4 and total() - cost(g[2], 4) + cost(g[2], 0) <= budget:
                g[1] = 0
    return [(p, d, cost(t, d)) for p, d, t in got]


def test_packing_by_brute_force(spark):
    cases = [(i, 100 + 150 * i, [(1 / (1 + j / 4), (j * 37 + i * 11) % 300 + 1, f"f{j}") for j in range(12)]) for i in range(8)] + [(9, 10, [])]
    df = spark.createDataFrame([(r, b, [{"relevance": x, "tokens": t, "path": p} for x, t, p in items]) for r, b, items in cases], "run_id bigint, budget bigint, items array<struct<relevance:double,tokens:bigint,path:string>>")
    got = {}
    listed = df.select("run_id", "budget", F.explode("items").alias("i")).select("run_id", "budget", "i.path", "i.relevance", "i.tokens")
    for r in sorted(K.packed(listed).collect(), key=lambda r: int(r.path[1:])):
        got.setdefault(r.run_id, []).append((r.path, r.depth, r.cost))
    for run, budget, items in cases:
        assert got.get(run, []) == pack_by_hand(budget, items)
        assert sum(c for *_, c in got.get(run, [])) <= budget


def test_traverse_takes_the_best_way(spark):
    edges = spark.createDataFrame([("a", "b", "links_to", 1.0), ("b", "c", "links_to", 1.0), ("a", "c", "links_to", 0.1)], "source string, target string, kind string, weight double")
    start = spark.createDataFrame([("a", 1.0)], "id string, relevance double")
    got = {r.id: r.relevance for r in G.traverse(edges, start).collect()}
    assert math.isclose(got["c"], 0.65**2) and got["a"] == 1.0


def test_impact_stops_at_hubs(spark):
    edges = spark.createDataFrame([(f"x{i}", "hub", "links_to", 1.0) for i in range(12)] + [("hub", "a", "links_to", 1.0)], "source string, target string, kind string, weight double")
    got = G.impact(edges, spark.createDataFrame([("a",)], "id string"))
    assert [(r.id, r.hops) for r in got.collect()] == [("hub", 1)]


def test_communities_of_two_cliques(spark):
    clique = lambda names: [(a, b, "k", 1.0) for a in names for b in names if a < b]
    edges = spark.createDataFrame(clique("abcd") + clique("wxyz") + [("d", "w", "k", 0.1)], "source string, target string, kind string, weight double")
    labels = {r.id: r.label for r in G.communities(edges).collect()}
    assert len({labels[c] for c in "abcd"}) == 1 and len({labels[c] for c in "wxyz"}) == 1 and labels["a"] != labels["z"]


def test_imports_resolve_by_path_end(spark):
    files = spark.createDataFrame([("c", "src/a/util.py"), ("c", "src/main.py"), ("d", "src/a/util.py")], "corpus_id string, path string")
    wanted = spark.createDataFrame([("c", "src/main.py", "a.util"), ("c", "src/main.py", "json")], "corpus_id string, path string, target string")
    assert [tuple(r) for r in G.suffix_matches(wanted, files).collect()] == [("c", "src/main.py", "a.util", "src/a/util.py")]


def test_visibility_fails_closed(spark):
    rows = spark.createDataFrame([("a", "public"), ("b", "restricted"), ("c", "odd"), ("d", None)], "id string, class string")
    seen = lambda cap: sorted(r.id for r in E.visible(rows, cap).collect())
    assert seen("public") == seen("unknown") == ["a"]
    assert seen("restricted") == ["a", "b", "c", "d"]


def test_keyword_score_prefers_path_hits(spark):
    files = spark.createDataFrame([("c", "src/vessel/rank.py", 1, "x", []), ("c", "src/other.py", 1, "x", [{"title": "The vessel"}]), ("c", "none.py", 1, "x", None)], "corpus_id string, path string, tokens int, knowledge_type string, headings array<struct<title:string>>")
    got = X.keyword_find(files, "vessel ranks!").collect()
    assert [r.path for r in got] == ["src/vessel/rank.py", "src/other.py"]
    assert got[0].relevance == 1.0 and math.isclose(got[1].relevance, 0.2)
    assert X.keyword_find(files, " ?").count() == 0


EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def test_streams_take_late_repeated_and_new_files(spark, tmp_path):
    from datetime import datetime

    from kelpline.streaming import events as S

    day = lambda d: datetime(2025, 1, d)
    put = lambda rows, n: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events{n}.parquet")
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    put([(1, day(1), 1, "a", 1.0), (2, day(2), 1, "a", 2.0), (2, day(2), 1, "a", 2.0)], 1)
    put([(3, day(1), 2, "a", 4.0), (1, day(1), 1, "a", 1.0)], 2)  # three is late, one is delivered again
    daily = lambda: {(r.day, r.events) for r in S.run_available(S.daily_stream(S.distinct_stream(stream()).select("event_id", "ts", "user_id", "event_type", "value")), "append", at=f"{tmp_path}/x").collect()}
    ids = lambda: sorted(r.event_id for r in S.run_available(S.distinct_stream(stream()), "append", at=f"{tmp_path}/d").collect())
    assert ids() == [1, 2, 3]
    put([(4, day(3), 1, "b", 1.0), (3, day(1), 2, "a", 4.0)], 3)
    assert ids() == [1, 2, 3, 4]  # the same folder continues where it ended
    sums = {(r.day, r.event_type): (r.events, r.value) for r in S.run_available(S.daily_stream(stream()), "update", ["day", "event_type"], f"{tmp_path}/u").collect()}
    assert sums == {("2025-01-01", "a"): (4, 10.0), ("2025-01-02", "a"): (2, 4.0), ("2025-01-03", "b"): (1, 1.0)}
    fired = S.run_available(S.triggers(stream(), volume=2), "append", at=f"{tmp_path}/t").groupBy("user_id", "reason").count().collect()
    assert {tuple(r) for r in fired} == {(1, "no prior centroid", 1), (2, "no prior centroid", 1), (1, "volume", 2)}
    put([(5, day(4), 2, "b", 1.0)], 4)
    fired = S.run_available(S.triggers(stream(), volume=2), "append", at=f"{tmp_path}/t").groupBy("user_id", "reason").count().collect()
    assert {tuple(r) for r in fired} == {(1, "no prior centroid", 1), (2, "no prior centroid", 1), (1, "volume", 2), (2, "volume", 1)}


def test_log_skips_bad_lines(spark, tmp_path):
    from datetime import datetime

    from kelpline.streaming import events as S

    rows = spark.createDataFrame([(i, datetime(2025, 1, i), 1, "a" if i % 2 else "b", 1.0) for i in range(1, 5)] + [(9, None, 1, "a", 1.0)], EVENT)
    S.append_events(rows.limit(2), f"{tmp_path}/log")
    S.append_events(rows.subtract(rows.limit(2)), f"{tmp_path}/log")
    bad = ["{not json", "7", "null", '["ts", 5]', '{"ts": "1735689600", "event_id": 21}', '{"ts": true, "event_id": 22}', "", '{"event_id": 23}']
    spark.createDataFrame([(x, "2025-01-03") for x in bad], "value string, day string").write.mode("append").partitionBy("day").text(f"{tmp_path}/log")
    fields = "event_id bigint, event_type string"
    assert sorted(r.event_id for r in S.read_events(spark, f"{tmp_path}/log", fields).collect()) == [1, 2, 3, 4]
    since = int(datetime(2025, 1, 3).timestamp())
    assert sorted(r.event_id for r in S.read_events(spark, f"{tmp_path}/log", fields, since).collect()) == [3, 4]
    assert [r.event_id for r in S.read_events(spark, f"{tmp_path}/log", fields, since, F.col("event_type") == "a").collect()] == [3]


def test_imports_resolve_by_path_ends(spark):
    files = spark.createDataFrame([("c", "src/a/util.ts"), ("c", "lib/util.ts"), ("c", "src/main.ts"), ("d", "util.ts")], "corpus_id string, path string")
    wanted = spark.createDataFrame([("c", "src/main.ts", "./a/util"), ("c", "src/main.ts", "util"), ("c", "src/main.ts", "react")], "corpus_id string, path string, target string")
    assert {(r.target, r.found) for r in G.suffix_matches(wanted, files).collect()} == {("./a/util", "src/a/util.ts"), ("util", "lib/util.ts")}
