"""Structure of indexed files: roles, heading trees, sections, exports, symbols by line, and the links between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by extension, and extensions by role.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "java": "java", "md": "markdown", "mdx": "markdown", "rst": "rst", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "css": "css", "html": "html", "sh": "shell"}
DOCS = ["md", "mdx", "rst", "txt"]
CODE = ["ts", "tsx", "js", "jsx", "mjs", "py", "rs", "go"]
#: Paths of tests, and paths that are not worth an index.
TESTS = r"\.test\.[tj]sx?$|\.spec\.[tj]sx?$|__tests__/|test_\w+\.py$|\w+_test\.py$|^tests?/"
SKIPPED = r"node_modules/|\.git/|dist/|build/|\.next/|__pycache__/|\.cache/|coverage/|\.turbo/|package-lock\.json$|yarn\.lock$|pnpm-lock\.yaml$|\.min\.(js|css)$|\.map$|\.d\.ts$|\.png$|\.jpg$|\.jpeg$|\.gif$|\.svg$|\.ico$|\.woff|\.ttf|\.eot"
#: How strong a kind of link between files is.
WEIGHTS = {"imports": 1.0, "tested_by": 0.6, "tests": 0.6, "documents": 0.5, "links_to": 0.5}
#: Forms of exported names.
TS_EXPORT = r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:declare\s+)?(?:(?:abstract\s+)?class|interface|type|enum|function|(?:const|let|var))\s+(\w+)"
PY_EXPORT = r"(?m)^(?:class|(?:async\s+)?def)\s+(\w+)"
FIRST_SENTENCE = r"^[^\n]*?[.!?](?:\s|$)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def base(path: Column) -> Column:
    """The file name without folders and without its last extension, in lower case."""
    return F.lower(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1))


def with_roles(files: DataFrame) -> DataFrame:
    """files with ext, language, is_test, is_doc, is_code, indexable."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    files = files.withColumn("ext", extension(F.col("path")))
    return (
        files.withColumn("language", F.coalesce(F.try_element_at(names, F.col("ext")), F.lit("other")))
        .withColumn("is_test", F.col("path").rlike(TESTS))
        .withColumn("is_doc", F.col("ext").isin(DOCS))
        .withColumn("is_code", F.col("ext").isin(CODE))
        .withColumn("indexable", ~F.col("path").rlike(SKIPPED) & (F.col("language") != "other"))
    )


def heading_tree(files: DataFrame) -> DataFrame:
    """(corpus_id, path, node, depth, title, parent, tokens, total): each heading, the last one of less depth before it, and its tokens with all below.

    parent is -1 at the top. A file's headings are one row's array.
    """
    h = F.col("headings")
    parent = lambda x, i: F.array_max(F.transform(F.filter(F.transform(F.slice(h, 1, i), lambda y, j: F.struct(y["depth"].alias("depth"), j.alias("j"))), lambda y: y["depth"] < x["depth"]), lambda y: y["j"]))
    end = lambda x, i: F.array_min(F.transform(F.filter(F.transform(F.slice(h, i + 2, F.size(h)), lambda y, j: F.struct(y["depth"].alias("depth"), j.alias("j"))), lambda y: y["depth"] <= x["depth"]), lambda y: y["j"]))
    below = lambda x, i: F.aggregate(F.slice(h, i + 1, F.coalesce(end(x, i) + 1, F.size(h))), F.lit(0).cast("bigint"), lambda n, y: n + y["tokens"])
    nodes = F.transform(h, lambda x, i: F.struct(i.alias("node"), x["depth"].alias("depth"), x["title"].alias("title"), F.coalesce(parent(x, i), F.lit(-1)).alias("parent"), x["tokens"].alias("tokens"), below(x, i).alias("total")))
    return files.filter(F.size("headings") > 0).select("corpus_id", "path", F.explode(nodes).alias("n")).select("corpus_id", "path", "n.*")


def sections(text: Column) -> Column:
    """array<struct<title, chars>> of a Markdown text: the text under each heading, up to the next heading."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)^(?=#{1,6}[ \t]+\S)")
    with_title = F.filter(parts, lambda p: p.rlike(r"^#{1,6}[ \t]+\S"))
    return F.transform(with_title, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^#{1,6}[ \t]+([^\n]*)", 1)).alias("title"), F.length(stripped(F.regexp_replace(p, r"^[^\n]*\n?", ""))).alias("chars")))


def first_sentence(text: Column) -> Column:
    """Up to the first end of a sentence in the first line, else the first line; 200 characters at most."""
    found = F.regexp_extract(text, FIRST_SENTENCE, 0)
    return F.substring(F.when(found != "", stripped(found)).otherwise(F.split(text, "\n")[0]), 1, 200)


def first_paragraph(text: Column) -> Column:
    return F.substring(stripped(F.split(text, "\n\n")[0]), 1, 500)


def exported(files: DataFrame) -> DataFrame:
    """(corpus_id, path, name) of the names that code files export."""
    form = F.when(F.col("ext") == "py", F.regexp_extract_all("content", F.lit(PY_EXPORT), 1)).when(F.col("ext").isin("ts", "tsx", "js", "jsx", "mjs"), F.regexp_extract_all("content", F.lit(TS_EXPORT), 1))
    return files.filter("content is not null").select("corpus_id", "path", F.explode(form).alias("name"))


def symbol_lines(files: DataFrame) -> DataFrame:
    """(corpus_id, path, name, first, last): Python symbols with their lines, nested ones included; a symbol ends before the next line of no more indent."""
    lines = F.transform(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n"), lambda l, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(l, r"^([ \t]*)\S", 1)).alias("indent"), F.regexp_extract(l, r"^[ \t]*(?:class|(?:async\s+)?def)\s+(\w+)", 1).alias("name"), (F.trim(l) == "").alias("blank")))
    each = files.filter("ext = 'py' and content is not null").select("corpus_id", "path", F.filter(lines, lambda x: ~x["blank"]).alias("ls"))
    last = lambda x: F.array_min(F.transform(F.filter(F.col("ls"), lambda y: (y["line"] > x["line"]) & (y["indent"] <= x["indent"])), lambda y: y["line"]))
    symbols = F.transform(F.filter("ls", lambda x: x["name"] != ""), lambda x: F.struct(x["name"].alias("name"), x["line"].alias("first"), F.coalesce(last(x) - 1, F.array_max(F.transform("ls", lambda y: y["line"]))).alias("last")))
    return each.select("corpus_id", "path", F.explode(symbols).alias("s")).select("corpus_id", "path", "s.*")


def innermost(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """lines (corpus_id, path, line) with the name of the innermost symbol around each; the latest begin wins. Symbols meet per file."""
    hits = lines.join(symbols, ["corpus_id", "path"]).filter("line between first and last")
    return hits.groupBy("corpus_id", "path", "line").agg(F.max_by("name", "first").alias("name"))


def test_links(files: DataFrame) -> DataFrame:
    """(corpus_id, source, target, kind): tests and what they test, by equal names, both ways."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(base(F.col("path")), r"\.(test|spec)$", ""), r"^test[_-]", ""), r"[_-]test$", "")
    tests = files.filter("is_test").select("corpus_id", F.col("path").alias("test"), name.alias("name"))
    code = files.filter("is_code").select("corpus_id", F.col("path").alias("code"), base(F.col("path")).alias("name"))
    both = tests.join(code, ["corpus_id", "name"]).filter("test <> code")
    one = lambda a, b, kind: both.select("corpus_id", F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("kind"))
    return one("test", "code", "tests").unionByName(one("code", "test", "tested_by"))


def doc_links(files: DataFrame, least: int = 1) -> DataFrame:
    """(corpus_id, source, target, kind): documents and the code whose name holds theirs, or is held by it.

    Each name offers all its parts of at least `least` characters, so that
    names meet by an equi-join; a shorter name is compared as a whole.
    """
    plain = F.regexp_replace(base(F.col("path")), "[-_]", "")
    names = files.filter("is_doc or is_code").select("corpus_id", "path", "is_doc", plain.alias("name")).filter("name <> ''")
    starts = F.sequence(F.lit(1), F.greatest(F.length("name") - (least - 1), F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), F.greatest(F.length("name") - i + 1, F.lit(least))), lambda n: F.substring("name", i, n))))
    offers = names.select("corpus_id", "path", "is_doc", F.explode(F.array_distinct(F.concat(parts, F.array("name")))).alias("part"))
    whole = names.select("corpus_id", F.col("path").alias("path_b"), F.col("is_doc").alias("doc_b"), F.col("name").alias("part"))
    met = offers.join(whole, ["corpus_id", "part"]).filter(F.col("is_doc") != F.col("doc_b"))
    doc, code = (F.when(F.col("is_doc"), F.col(a)).otherwise(F.col(b)) for a, b in (("path", "path_b"), ("path_b", "path")))
    return met.select("corpus_id", doc.alias("source"), code.alias("target"), F.lit("documents").alias("kind")).distinct()


def weighted(links: DataFrame) -> DataFrame:
    """links with the weight of their kind."""
    return links.withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("kind")))


def resolved(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (name) with the files that export it: how many, the first, and whether it is the only one."""
    known = names.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.min(F.concat_ws(":", "corpus_id", "path")).alias("first_file"))
    return asked.join(known, "name", "left").select("name", F.coalesce("files", F.lit(0)).alias("files"), "first_file", (F.coalesce("files", F.lit(0)) == 1).alias("strict"))


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Rows of one page of an ordered result; a top-k over the pages up to it."""
    w = Window.orderBy(*order)
    return rows.orderBy(*order).limit(number * size).withColumn("at", F.row_number().over(w)).filter(F.col("at") > (number - 1) * size)
