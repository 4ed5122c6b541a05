import pytest

from kelpline.llm import handwritten as H
from kelpline.llm import names as N
from pyspark.sql import functions as F


def alike(a, b, kind):
    x, y = N.tokens(a, kind), N.tokens(b, kind)
    common = {"marine": 1.0, "group": 0.5, "partners": 0.5, "acoustics": 1.0, "research": 1.0}
    w = {t: common.get(t, 1.5 if t in N._SHORT_OF else 5.0) for t in x + y}
    return N.similarity(x, y, w, kind) >= N.SIMILAR


@pytest.mark.parametrize("a, b", [("Nordvik Marine AS", "NORDVIK-MARINE (HQ) Ltd"), ("Marine Group, Nordvik", "Nordvik Marine"), ("Nrodvik Marine", "Nordvik Marine"), ("NordvikMarine", "Nordvik Marine"), ("NORDVIKMARINE", "Nordvik Marine"), ("Nordvik Mar. Grp", "Nordvik Marine Group"), ("Nørdvik S.p.A.", "Noerdvik Sarl")])
def test_same_organisation(a, b):
    assert alike(a, b, "org")


@pytest.mark.parametrize("a, b", [("Nordvik Marine", "Nordvik Acoustics"), ("Nordvik Marine", "Sorvikas Marine"), ("Nordvik Acoustics Group", "Nordvik Research Group")])
def test_other_organisation(a, b):
    assert not alike(a, b, "org")


@pytest.mark.parametrize("a, b", [("Dr. Gabriel Tagoseno", "Tagoseno, Gabe"), ("Élodie Marserik", "Elodie Marserikk, PhD"), ("Hans Britavan", "Johannes Britavan-Drusen"), ("Michael T. Calvil", "Mike Calvil")])
def test_same_person(a, b):
    assert alike(a, b, "person")


@pytest.mark.parametrize("a, b", [("Stefan Branusilen", "Patricia Branusilen"), ("Stefan Sadababy", "Stefan S. Dartefanby"), ("J. Tagoseno", "M. Tagoseno"), ("Margaret Osga", "Marguerite Osga")])
def test_other_person(a, b):
    assert not alike(a, b, "person")


ENTITY = "kind string, id string, names array<string>, org struct<display_name:string>, person struct<display_name:string,title:string,affiliations:array<string>>, key string, set string"


def entity(kind, id_, names, title=None, at=None, shown=None):
    return (kind, id_, names, {"display_name": shown} if kind == "org" else None, {"display_name": shown, "title": title, "affiliations": at} if kind == "person" else None, "clash", "clash")


def test_sets_of_variants(spark):
    rows = [
        entity("org", "o1", ["Nordvik Marine AS"]), entity("org", "o1", ["Nordvik Marine AS"]), entity("org", "o2", ["Nordvik Marinne"]), entity("org", "o3", ["NMA", "Nordvik Marine AS"]), entity("org", "o4", ["Nordvik Acoustics"]), entity("org", "o5", ["NMA"]),
        entity("person", "p1", ["Michael Calvilorto"], "Broker", ["org:a"]), entity("person", "p2", ["Mike Calvilorto"]), entity("person", "p3", ["Margaret Calvilorto"], "Pilot"), entity("person", "p4", ["M. Calvilorto"], None, ["org:a"]), entity("person", "p5", ["M Calvilorto"]), entity("person", "p6", [None, " "]), entity("person", "p7", None, shown="Calvilorto, Michael"),
        entity("concept", "c1", ["Nordvik Marine AS"]), entity("org", None, ["Nordvik Marine AS"]),
    ]
    df = spark.createDataFrame(rows, ENTITY)
    got = {(r.id_a, r.id_b) for r in N.variant_pairs(N.variants(df)).collect()}
    assert got == {("o1", "o2"), ("o1", "o3"), ("o2", "o3"), ("p1", "p2"), ("p1", "p7"), ("p2", "p7"), ("p1", "p4"), ("p2", "p4"), ("p4", "p7")}
    assert N.variants(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z1", "z2")], "a string, b string")
    got = {r.node: r.set for r in N.components(edges).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["z2"] == "z1"


def test_containing_keys_are_candidates(spark):
    keys = spark.createDataFrame([("org", k) for k in ("marine nordvik", "acoustic nordvik", "group marine nordvik", "optic sorlandet", "optic sorlandett")], "kind string, key string")
    got = {(r.a, r.b) for r in N.candidates(keys).collect()}
    assert ("group marine nordvik", "marine nordvik") in got and ("optic sorlandet", "optic sorlandett") in got


def code(i):
    return "def load_%d(rows, limit=%d):\n    seen = set()\n    for row in rows:\n        if row in seen:\n            continue\n        seen.add(row)\n    return sorted(seen)[:limit]\n" % (i, i)


def made(i):
    return "".join(f"export const getField{i}_{j} = (m) => m.fields_[{j}];\nexport const setField{i}_{j} = (m, v) => {{ m.fields_[{j}] = v; }};\n" for j in range(12))


def test_files_not_by_hand(spark):
    files, want = [], set()

    def add(corpus, path, content, case, lang="python"):
        files.append((corpus, path, content, lang))
        if case:
            want.add((corpus, path))

    for i in range(60):
        c = f"c{i % 8}"
        add(c, f"src/mod{i}/load{i}.py", code(i), False)
        add(c, f"src/mod{i}/gen{i}.ts", f"// Code generated by fieldgen. DO NOT EDIT.\n{made(i)}" if i % 29 else made(i), True, "typescript")
        add(c, f"src/{'abcdefgh'[i % 8]}/{'abcdefgh'[i // 8]}.py", code(100 + i), False)  # names of all kinds
    for i in range(24):  # a mark is learned from several repositories
        add(f"c{i % 8}", f"{('lib/vendor', 'node_modules', 'third_party')[i % 3]}/t{i}.{('py', 'js', 'go')[i % 3]}", code(920 + i), True)
        add(f"c{i % 8}", f"src/up{i}.py", f"# Part of upthing 1.2.{i}. Licensed under the Apache License, Version 2.0\n" + code(950 + i), True)
        add(f"c{i % 8}", f"src/hand{i}.py", "# Dieser Quelltext wurde von abcgen erzeugt und wird bei jedem Lauf überschrieben.\n" + code(980 + i), True)
    add("c0", "src/own.py", "# Copyright the own authors. Licensed under the MIT licence; see LICENSE.\n" + code(901), False)
    add("c0", "src/banner.py", 'BANNER = "Code generated by x. DO NOT EDIT."\n' + code(902), False)
    add("c0", "src/vendors/a.py", code(903), False)
    add("c0", "lib/vendor/a.py", code(904), True)
    add("c1", "src/up.py", "# Part of upthing 1.2.3. Licensed under the Apache License, Version 2.0\n" + code(905), True)
    copied = code(906).replace("seen", "visited").replace("row", "upstream_item")
    add("c2", "src/lib/copy.py", copied, True)
    add("c3", "src/other/copy2.py", copied, True)
    add("c1", "src/hand.py", "# Dieser Quelltext wurde von abcgen erzeugt und wird bei jedem Lauf überschrieben.\n" + code(907), True)
    add("c1", "docs/vendor/page.md", "# Code generated by nobody\n\nProse about vendor folders.", False, "markdown")
    add("c1", "src/null.py", None, False)
    add("c1", "node_modules/null.js", None, True)
    entries = spark.createDataFrame([(c, p, 1) for c, p, *_ in files] * 2 + [("c9", "third_party/x.go", 1), ("c9", None, 1), (None, "a.py", 1)], "corpus_id string, file_id string, body int")
    want.add(("c9", "third_party/x.go"))
    sources = spark.createDataFrame([(c, p, t, lang, n) for c, p, t, lang in files for n in (1, 2)], "corpus_id string, path string, content string, lang string, n int").withColumn("indexed_at", F.timestamp_seconds("n")).withColumn("hash", F.lit("h"))
    got = {(r.corpus_id, r.file_id) for r in H.not_by_hand(entries, sources).collect()}
    assert got - want == set() and len(want - got) <= 1  # of three files that bear no sign
    assert H.not_by_hand(entries.limit(0), sources).count() == 0


def test_margins_agree_with_features():
    import numpy as np

    w = np.random.default_rng(0).normal(size=H.WIDTH + 1)
    body, path = ["abc 123\n" * 5, "", "é", code(1)], ["a/b.py", "x", "", "d/e/f.ts"]
    header = ["", "# Generated by x\n", "// é 1", ""]
    one = [w[c] @ v + w[-1] for c, v in H.features(body, header, path)]
    assert np.allclose(H.margins(body, header, path, w), one)
    assert np.allclose(H.margins(body[::-1], header[::-1], path[::-1], w)[::-1], one)
