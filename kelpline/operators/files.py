"""Operators over indexed files: keyword ranking, classes, headings, imports, changes between indexings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import STEM_PATTERN, stem

#: Patterns by class, without regard to case, each 2 in the path and 1 in the headings; the first class with the most points wins.
CLASSES = {
    "ground_truth": (
        [r"\.ts$", r"\.tsx$", r"\.js$", r"\.jsx$", r"\.py$", r"\.rs$", r"\.go$", r"\.vue$", r"\.svelte$", r"schema", r"types\.", r"interface", r"\.proto$", r"config\.(ts|js|json|yaml|yml)$", r"\.env", r"package\.json$", r"tsconfig", r"Dockerfile", r"PRD", r"SPEC", r"API[-_]", r"SCHEMA"],
        [r"api\s*(reference|doc)", r"specification", r"schema", r"type\s*definition", r"interface", r"endpoint"],
    ),
    "framework": (
        [r"GUIDE", r"GUIDELINE", r"CONVENTION", r"ARCHITECTURE", r"DESIGN[-_]", r"PATTERN", r"PLAYBOOK", r"PROCESS", r"METHODOLOGY", r"PRINCIPLES", r"RULES", r"\.md$.*rules", r"CONTRIBUTING"],
        [r"guideline", r"convention", r"architecture", r"design\s*system", r"pattern", r"principle", r"methodology", r"workflow", r"best\s*practice", r"how\s*to", r"playbook"],
    ),
    "evidence": (
        [r"AUDIT", r"BENCHMARK", r"RESEARCH", r"ANALYSIS", r"REPORT", r"STUDY", r"EVAL", r"METRIC", r"research", r"raw/", r"scrape", r"screenshot", r"battlecard", r"FEATURES\.md"],
        [r"benchmark", r"result", r"finding", r"metric", r"comparison", r"competitive", r"analysis", r"scraped", r"source", r"evidence"],
    ),
    "signal": (
        [r"FEEDBACK", r"REVIEW", r"RETRO", r"INTERVIEW", r"MEETING", r"NOTES", r"STANDUP", r"DISCUSSION", r"slack", r"message", r"transcript"],
        [r"feedback", r"review", r"retrospective", r"interview", r"meeting\s*note", r"decision", r"action\s*item"],
    ),
    "hypothesis": (
        [r"PLAN", r"PROPOSAL", r"RFC", r"ROADMAP", r"VISION", r"IDEA", r"DRAFT", r"TODO", r"SPRINT", r"BACKLOG", r"REMAINING"],
        [r"proposal", r"rfc", r"roadmap", r"plan", r"next\s*step", r"future", r"goal", r"objective", r"sprint", r"milestone"],
    ),
    "artifact": (
        [r"CHANGELOG", r"RELEASE", r"GENERATED", r"dist/", r"build/", r"output/", r"README", r"LICENSE", r"CONTRIBUTING", r"test[-_]result", r"\.(csv|json)$"],
        [r"changelog", r"release\s*note", r"version", r"generated", r"output", r"export"],
    ),
}
#: Words that say nothing about a topic.
STOP_WORDS = """
the is are what how does do a an in on of for to and or it its this that with from by at as be was were been has have had can will
les le la un une des du de en et ou que qui comment est sont ce cette nous on dans pour par sur avec pas plus tout fait faire
""".split()
#: Fixed value: what a query's words may hold.
NOT_IN_QUERY = r"[^a-z0-9àâäéèêëïîôùûüÿçœæ\s\-_/]"


def latest(files: DataFrame) -> DataFrame:
    """The last indexed row of each (corpus_id, path); ties go to the larger hash."""
    w = Window.partitionBy("corpus_id", "path").orderBy(F.desc("indexed_at"), F.desc_nulls_last("hash"), F.desc("tokens"))
    return files.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def query_tokens(query: str) -> list[str]:
    return [w for w in re.sub(NOT_IN_QUERY, " ", query.lower()).split() if len(w) >= 2]


def points_sql(t: str) -> list[str]:
    """SQL of a token's points in the path, the headings, the file name and the folder.

    Reads path_lower, path_parts, heads, head_words, file_lower, file_parts and
    dir_lower; the best hit of each place counts. Only words that hold the
    token's stem are stemmed.
    """
    s = stem(t)

    def stemmed(words: str, test: str) -> str:
        of = f"regexp_replace(x, '{STEM_PATTERN}', '$1')"
        return f"exists({words}, x -> contains(x, '{s}') and length(x) >= 3 and {test.format(of)})"

    same, holds = f"{{0}} = '{s}'", f"contains({{0}}, '{s}')"
    return [
        f"(case when array_contains(path_parts, '{t}') then 0.3 when {stemmed('path_parts', same)} then 0.25 when contains(path_lower, '{t}') then 0.15 else 0 end)",
        f"(case when contains(heads, '{t}') then 0.2 when {stemmed('head_words', holds)} then 0.15 else 0 end)",
        f"(case when array_contains(file_parts, '{t}') then 0.2 when {stemmed('file_parts', same)} then 0.15 when contains(file_lower, '{t}') then 0.1 else 0 end)",
        f"(case when contains(dir_lower, '{t}') then 0.1 else 0 end)",
    ]


def keyword_columns(files: DataFrame) -> DataFrame:
    """files with the columns that points_sql reads."""
    long = lambda c: f"filter({c}, x -> length(x) >= 2)"
    name = r"regexp_extract(path, '([^/]*?)([.][^./]*)?$', 1)"
    return (
        files.withColumn("path_lower", F.lower("path"))
        .withColumn("path_parts", F.expr(long("split(path_lower, '[-/_.]')")))
        .withColumn("heads", F.lower(F.coalesce(F.array_join(F.col("headings.title"), " "), F.lit(""))))
        .withColumn("head_words", F.split("heads", r"\s+"))
        .withColumn("file_lower", F.expr(name))
        .withColumn("file_parts", F.expr(long(r"split(lower(regexp_replace(file_lower, '([a-z0-9])([A-Z])', '$1 $2')), r'[\s_-]+')")))
        .withColumn("dir_lower", F.expr("lower(regexp_extract(path, '^(.*)/[^/]*$', 1))"))
    )


def keyword_scored(files: DataFrame, query: str) -> DataFrame:
    """files with `relevance`, each token's points computed once."""
    tokens = query_tokens(query)
    rows = keyword_columns(files)
    for i, t in enumerate(tokens):
        rows = rows.withColumn(f"_p{i}", F.expr(" + ".join(points_sql(t))).cast("double"))
    points = [F.col(f"_p{i}") for i in range(len(tokens))]
    matched = sum((p > 0).cast("int") for p in points) if points else F.lit(0)
    bonus = F.when(matched >= 2, matched * 0.3 / len(tokens)).otherwise(0.0) if len(tokens) > 1 else F.lit(0.0)
    total = sum(points) if points else F.lit(0.0)
    return rows.withColumn("relevance", F.round(F.least(F.lit(1.0), total + bonus), 6)).drop(*[f"_p{i}" for i in range(len(tokens))])


def keyword_find(files: DataFrame, query: str, top: int = 20) -> DataFrame:
    """The best files by keywords, ties by corpus and path. A top-k over all files, without a full sort."""
    return keyword_scored(files, query).select("corpus_id", "path", "tokens", "knowledge_type", "relevance").filter("relevance > 0").orderBy(F.desc("relevance"), "corpus_id", "path").limit(top)


def topic_terms(query: str) -> list[str]:
    return [t for t in query_tokens(query) if len(t) >= 3 and t not in STOP_WORDS]


def file_class(path: Column, heads: Column) -> Column:
    """The class of the most points; of several the first; without any, by the extension."""
    points = [sum(F.when(path.rlike(f"(?i){p}"), 2).otherwise(0) for p in paths) + sum(F.when(heads.rlike(f"(?i){p}"), 1).otherwise(0) for p in titles) for paths, titles in CLASSES.values()]
    places = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (n, name) in enumerate(zip(points, CLASSES))])
    best = F.array_max(places)
    return F.when(best["n"] > 0, best["name"]).when(path.rlike(r"(?i)\.mdx?$"), "evidence").otherwise("artifact")


def imports(files: DataFrame) -> DataFrame:
    """(corpus_id, path, target): distinct modules that a file imports, by the forms of its language."""
    forms = {"python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "javascript": r"""(?:from|require\()\s*['"]([^'"]+)['"]()""", "typescript": r"""(?:from|require\()\s*['"]([^'"]+)['"]()""", "go": r"""(?m)^import\s+"([^"]+)"()""", "rust": r"(?m)^\s*use\s+([\w:]+)()", "java": r"(?m)^import\s+(?:static\s+)?([\w.]+)();"}
    found = F.array().cast("array<string>")
    for lang, form in forms.items():
        both = F.concat(F.regexp_extract_all("content", F.lit(form), 1), F.regexp_extract_all("content", F.lit(form), 2))
        found = F.when(F.col("lang") == lang, both).otherwise(found)
    return files.filter("content is not null").select("corpus_id", "path", F.explode(found).alias("target")).filter("target <> ''").distinct()


def changes(files: DataFrame) -> DataFrame:
    """Each indexing of a file against the one before: new, same or changed."""
    w = Window.partitionBy("corpus_id", "path").orderBy("indexed_at", "hash")
    before = F.lag("hash").over(w)
    first = F.row_number().over(w) == 1
    return files.withColumn("change", F.when(first, "new").when(before.eqNullSafe(F.col("hash")), "same").otherwise("changed"))


def folders(files: DataFrame) -> DataFrame:
    """(corpus_id, folder, files, tokens) of every folder above a file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.filter(F.size(parts) > 1).select("corpus_id", "tokens", F.explode(above).alias("folder")).groupBy("corpus_id", "folder").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))
