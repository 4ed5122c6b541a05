from datetime import datetime

from kelpline.operators import references as R
from kelpline.plans.joins import salted_join
from kelpline.plans.ranks import with_global_rank

REFS = "field string, row_id bigint, ref_id string, at timestamp"
TIMES = "field string, ref_id string, at timestamp"


def at(day):
    return datetime(2025, 1, day)


def test_orphans_by_time(spark):
    created = spark.createDataFrame([("w", "a", at(5)), ("w", "a", at(3)), ("w", "b", at(1)), ("w", None, at(1)), ("w", "d", None)], TIMES)
    deleted = spark.createDataFrame([("w", "b", at(4)), ("w", "b", at(9))], TIMES)
    refs = spark.createDataFrame([("w", 1, "a", at(3)), ("w", 2, "a", at(2)), ("w", 3, "b", at(3)), ("w", 4, "b", at(4)), ("w", 5, "c", at(9)), ("w", 6, "d", at(9)), ("w", 7, "a", None), ("w", 8, "c", None)], REFS)
    state = R.existence_state(R.existence_deltas(created, deleted))
    for hot in (100, 0):  # also with every key split
        assert sorted(r.row_id for r in R.orphans(refs, state, hot).collect()) == [2, 4, 5, 6, 8]


def test_references_are_cleaned(spark):
    rows = spark.createDataFrame([(1, [" A:b ", "a:B", None, "", "https://x"], None, at(1)), (2, None, [{"source_id": "\tDoc:1 "}, {"source_id": None}], at(1)), (3, [], [], at(1))], "row_id bigint, wiki_links array<string>, evidence array<struct<source_id:string>>, updated_at timestamp")
    assert sorted((r.field, r.row_id, r.ref_id) for r in R.entity_references(rows).collect()) == [("evidence", 2, "doc:1"), ("wiki_links", 1, "a:b")]
    assert R.entity_references(rows.limit(0)).count() == 0


ENTRIES = "field string, ref_id string, row_id bigint, sign bigint, at timestamp"


def test_ledger_of_deltas(spark):
    created, deleted, ref = (lambda k, d: ("w", k, None, 1, at(d))), (lambda k, d: ("w", k, None, -1, at(d))), (lambda k, row, d, sign=1: ("w", k, row, sign, at(d)))
    batches = [
        [ref("a", 1, 5), ref("b", 2, 5), ref("c", 3, 5), ref("d", 4, 5), ref("d", 5, 9), ("w", None, 6, 1, at(1))],
        [created("a", 7), created("a", 7), created("b", 1), created("d", 6)],  # a is created late, and twice
        [deleted("b", 4), deleted("c", 2)],  # c is deleted before it is created
        [created("b", 1), ref("a", 1, 5), created("a", 3), created("c", 3)],  # delivered again; a turns out to be earlier
        [ref("d", 5, 10, -1)],
    ]
    for order in (batches, batches[::-1]):
        ledger = None
        for batch in order:
            ledger = R.apply_deltas(ledger, spark.createDataFrame(batch, ENTRIES))
        counts = {r.ref_id: (r.refs, r.existence) for r in R.ledger_counts(ledger).collect()}
        assert counts == {"a": (1, 1), "b": (1, 0), "c": (1, 0), "d": (1, 1)}
        assert sorted(r.ref_id for r in R.current_orphans(R.ledger_counts(ledger)).collect()) == ["b", "c"]
        assert {r.ref_id: r.refs for r in R.ledger_counts(ledger, ends=False).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2}
        for hot in (100, 0):
            assert sorted(r.row_id for r in R.ledger_orphans(ledger, hot).collect()) == [2, 3, 4]


def test_maintained_ledger_takes_late_batches(spark):
    rows = [("w", "a", 1, 1, at(5), at(6)), ("w", "a", None, 1, at(1), at(28)), ("w", "b", 2, 1, at(5), None), ("w", "a", 1, 1, at(5), at(28))]
    deltas = spark.createDataFrame(rows, ENTRIES + ", arrived timestamp")
    for days in (3, 60):
        assert [r.ref_id for r in R.ledger_orphans(R.maintained(deltas, days)).collect()] == ["b"]
    assert R.ledger_orphans(R.maintained(deltas.limit(0))).count() == 0


def test_references_end(spark):
    rows = [(1, "A", ["x", "y"], at(1)), (2, "a ", ["y"], at(2)), (3, "b", ["x"], at(1)), (4, None, ["z"], at(1)), (5, "c", ["w"], at(1))]
    entities = spark.createDataFrame([(*r[:3], None, r[3]) for r in rows], "row_id bigint, id string, wiki_links array<string>, evidence array<struct<source_id:string>>, updated_at timestamp")
    deletions = spark.createDataFrame([("B", at(3)), ("b", at(5)), ("c", None)], "entity_id string, deleted_at timestamp")
    got = R.reference_deltas(entities, deletions).groupBy("ref_id").sum("refs").collect()
    assert sorted(map(tuple, got)) == [("w", 1), ("x", 0), ("y", 1), ("z", 1)]


def test_salted_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (3, 51)], "k int, i int")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(tuple, salted_join(left, right, ["k"], how, left["i"], hot_rows=10).select("k", "i").collect()))
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "i").collect()))


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("1000 - id as v").repartition(7)
    ranked = with_global_rank(df, ["v"]).orderBy("v").collect()
    assert [r["rank"] for r in ranked] == list(range(1000))
    assert with_global_rank(df.limit(0), ["v"]).count() == 0
