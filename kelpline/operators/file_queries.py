"""Queries over files and documents and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import files as X
from kelpline.operators.ranking_queries import KEYWORD
from kelpline.tables import table

QUERY = "vessel signal ranking schema"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest(table(spark, sf_dir, "source_files"))


def keyword_find(spark, sf_dir):
    return X.keyword_find(_latest(spark, sf_dir), QUERY)


def topic_filter(spark, sf_dir):
    """Keyword hits that also hold a quarter of the topic terms, or score half, re-ranked."""
    found = X.keyword_scored(_latest(spark, sf_dir), QUERY).filter("relevance > 0")
    terms = X.topic_terms(QUERY)
    topic = sum(F.when(F.contains(F.concat_ws(" ", "heads", "path_lower"), F.lit(t)), 1).otherwise(0) for t in terms) / float(len(terms))
    kept = found.withColumn("topic", F.round(topic, 6)).filter("topic >= 0.25 or relevance >= 0.5 or (knowledge_type = 'ground_truth' and relevance >= 0.35)")
    return kept.withColumn("combined", F.round(0.6 * F.col("relevance") + 0.4 * F.col("topic"), 6)).select("corpus_id", "path", "relevance", "topic", "combined").orderBy(F.desc("combined"), "corpus_id", "path").limit(50)


def file_tokens(spark, sf_dir):
    return _latest(spark, sf_dir).select("corpus_id", "path", T.estimated_tokens(F.col("content")).alias("estimated"), T.content_hash(F.col("content")).alias("md5_12"))


def file_classes(spark, sf_dir):
    heads = F.lower(F.coalesce(F.array_join(F.col("headings.title"), " "), F.lit("")))
    rows = X.latest(table(spark, sf_dir, "source_files").select("corpus_id", "path", "headings", "indexed_at", "hash", "tokens")).select("corpus_id", "path", heads.alias("h"))
    return rows.select("corpus_id", X.file_class(F.col("path"), F.col("h")).alias("class")).groupBy("corpus_id", "class").agg(F.count(F.lit(1)).alias("files"))


def file_summary(spark, sf_dir):
    rows = _latest(spark, sf_dir)
    return rows.groupBy("corpus_id", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"), F.sum("size").alias("bytes"), F.countDistinct("hash").alias("contents"))


def file_headings(spark, sf_dir):
    rows = _latest(spark, sf_dir).filter("lang = 'markdown'")
    return rows.select("corpus_id", "path", F.explode(T.headings(F.col("content"))).alias("h")).select("corpus_id", "path", "h.line", "h.depth", "h.title")


def file_imports(spark, sf_dir):
    return X.imports(_latest(spark, sf_dir)).groupBy("target").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("corpus_id").alias("corpora"))


def file_changes(spark, sf_dir):
    return X.changes(table(spark, sf_dir, "source_files")).groupBy("corpus_id", "change").agg(F.count(F.lit(1)).alias("rows"))


def file_folders(spark, sf_dir):
    return X.folders(_latest(spark, sf_dir))


def file_copies(spark, sf_dir):
    """Contents that several files hold."""
    rows = _latest(spark, sf_dir).filter("content is not null")
    return rows.groupBy(F.md5("content").alias("md5")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("corpus_id").alias("corpora"), F.min(F.concat_ws(":", "corpus_id", "path")).alias("first_file")).filter("files > 1")


def file_coverage(spark, sf_dir):
    """Of each corpus: files, entries' files, and those of each without the other."""
    files = _latest(spark, sf_dir).select("corpus_id", F.col("path").alias("file_id"), F.lit(True).alias("indexed"))
    entries = table(spark, sf_dir, "embedding_entries").select("corpus_id", "file_id").distinct().withColumn("embedded", F.lit(True))
    both = files.join(entries, ["corpus_id", "file_id"], "full")
    return both.groupBy("corpus_id").agg(F.count_if("indexed").alias("indexed"), F.count_if("embedded").alias("embedded"), F.count_if(F.col("embedded").isNull()).alias("not_embedded"), F.count_if(F.col("indexed").isNull()).alias("not_indexed"))


def doc_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc")).filter("docs > 1")


def doc_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "doc_type").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") != F.char_length("text")).alias("wrong_counts"), F.count_if(F.col("text").isNull()).alias("null_texts"))


def doc_refs(spark, sf_dir):
    """[[references]] of the documents, by target, with those that no document's title slug has."""
    docs = table(spark, sf_dir, "documents")
    refs = docs.select("doc_id", F.explode(T.wikirefs(F.col("text"))).alias("r")).select("doc_id", T.slug(F.col("r.target")).alias("target"))
    known = docs.filter("title is not null").select(T.slug(F.col("title")).alias("target"), F.lit(True).alias("known")).distinct()
    return refs.join(known, "target", "left").groupBy("target").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("doc_id").alias("docs"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("exists"))


def doc_pages(spark, sf_dir):
    """The front matter of the pages and the rules they break."""
    front = F.regexp_extract("text", r"^---\r?\n([\s\S]*?)\r?\n---\r?\n", 1)
    key = lambda k: F.nullif(F.trim(F.regexp_extract(F.col("front"), rf"(?m)^{k}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    pages = table(spark, sf_dir, "documents").withColumn("front", front).filter("front <> ''").select("doc_id", key("id").alias("page_id"), key("kind").alias("kind"), key("confidence").cast("double").alias("confidence"))
    broken = F.filter(F.array(F.when(F.col("page_id").isNull(), F.lit("id")), F.when(~F.coalesce(F.col("kind"), F.lit("")).isin("entity", "decision", "concept", "code"), F.lit("kind")), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), F.lit("confidence"))), lambda x: x.isNotNull())
    return pages.withColumn("broken", F.array_join(broken, ","))


QUERIES = {f.__name__: f for f in [keyword_find, topic_filter, file_tokens, file_classes, file_summary, file_headings, file_imports, file_changes, file_folders, file_copies, file_coverage, doc_copies, doc_sources, doc_refs, doc_pages]}

_LAST = """with last as (select * exclude (_r) from (select *, row_number() over (partition by corpus_id, path order by indexed_at desc, hash desc nulls last, tokens desc) as _r from source_files) where _r = 1)
"""
SQL = {
    "keyword_find": f"with {KEYWORD} select corpus_id, path, tokens, knowledge_type, relevance from k join (select corpus_id, path, knowledge_type from last) using (corpus_id, path) order by relevance desc, corpus_id, path limit 20",
    "topic_filter": f"""with {KEYWORD}, z as (select k.corpus_id, k.path, relevance, knowledge_type, round((contains(h, 'vessel')::int + contains(h, 'signal')::int + contains(h, 'ranking')::int + contains(h, 'schema')::int) / 4.0::double, 6) as topic from k join (select corpus_id, path, knowledge_type, concat_ws(' ', lower(coalesce(array_to_string(list_transform(headings, lambda x: x.title), ' '), '')), lower(path)) as h from last) using (corpus_id, path))
select corpus_id, path, relevance, topic, round(0.6::double * relevance + 0.4::double * topic, 6) as combined from z where topic >= 0.25 or relevance >= 0.5 or (knowledge_type = 'ground_truth' and relevance >= 0.35) order by combined desc, corpus_id, path limit 50""",
    "file_tokens": _LAST + """select corpus_id, path, case when coalesce(length(content), 0) = 0 then 0 else greatest(floor((length(content) - f) / 4.0::double + f / 2.5::double)::bigint, 1) end as estimated, left(md5(content), 12) as md5_12
from (select *, coalesce(list_sum(list_transform(regexp_extract_all(content, '```[\\s\\S]*?```'), lambda x: length(x))), 0)::double as f from last)""",
    "file_classes": _LAST + r""", c(ord, class, paths, titles) as (values
(0, 'ground_truth', ['\.ts$', '\.tsx$', '\.js$', '\.jsx$', '\.py$', '\.rs$', '\.go$', '\.vue$', '\.svelte$', 'schema', 'types\.', 'interface', '\.proto$', 'config\.(ts|js|json|yaml|yml)$', '\.env', 'package\.json$', 'tsconfig', 'Dockerfile', 'PRD', 'SPEC', 'API[-_]', 'SCHEMA'], ['api\s*(reference|doc)', 'specification', 'schema', 'type\s*definition', 'interface', 'endpoint']),
(1, 'framework', ['GUIDE', 'GUIDELINE', 'CONVENTION', 'ARCHITECTURE', 'DESIGN[-_]', 'PATTERN', 'PLAYBOOK', 'PROCESS', 'METHODOLOGY', 'PRINCIPLES', 'RULES', '\.md$.*rules', 'CONTRIBUTING'], ['guideline', 'convention', 'architecture', 'design\s*system', 'pattern', 'principle', 'methodology', 'workflow', 'best\s*practice', 'how\s*to', 'playbook']),
(2, 'evidence', ['AUDIT', 'BENCHMARK', 'RESEARCH', 'ANALYSIS', 'REPORT', 'STUDY', 'EVAL', 'METRIC', 'research', 'raw/', 'scrape', 'screenshot', 'battlecard', 'FEATURES\.md'], ['benchmark', 'result', 'finding', 'metric', 'comparison', 'competitive', 'analysis', 'scraped', 'source', 'evidence']),
(3, 'signal', ['FEEDBACK', 'REVIEW', 'RETRO', 'INTERVIEW', 'MEETING', 'NOTES', 'STANDUP', 'DISCUSSION', 'slack', 'message', 'transcript'], ['feedback', 'review', 'retrospective', 'interview', 'meeting\s*note', 'decision', 'action\s*item']),
(4, 'hypothesis', ['PLAN', 'PROPOSAL', 'RFC', 'ROADMAP', 'VISION', 'IDEA', 'DRAFT', 'TODO', 'SPRINT', 'BACKLOG', 'REMAINING'], ['proposal', 'rfc', 'roadmap', 'plan', 'next\s*step', 'future', 'goal', 'objective', 'sprint', 'milestone']),
(5, 'artifact', ['CHANGELOG', 'RELEASE', 'GENERATED', 'dist/', 'build/', 'output/', 'README', 'LICENSE', 'CONTRIBUTING', 'test[-_]result', '\.(csv|json)$'], ['changelog', 'release\s*note', 'version', 'generated', 'output', 'export'])),
r as (select corpus_id, path, lower(coalesce(array_to_string(list_transform(headings, lambda h: h.title), ' '), '')) as h from last),
n as (select corpus_id, path, class, ord, 2 * len(list_filter(paths, lambda p: regexp_matches(path, p, 'i'))) + len(list_filter(titles, lambda p: regexp_matches(h, p, 'i'))) as n from r cross join c),
b as (select corpus_id, path, arg_max(class, n * 10 - ord) as class, max(n) as n from n group by 1, 2)
select corpus_id, case when n > 0 then class when regexp_matches(path, '[.]mdx?$', 'i') then 'evidence' else 'artifact' end as class, count(*) as files from b group by 1, 2""",
    "file_summary": _LAST + "select corpus_id, lang, count(*) as files, sum(tokens)::bigint as tokens, sum(size)::bigint as bytes, count(distinct hash) as contents from last group by 1, 2",
    "file_headings": _LAST + r""", l as (select corpus_id, path, regexp_split_to_array(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n') as ls from last where lang = 'markdown' and content is not null),
e as (select corpus_id, path, unnest(range(len(ls))) as i, unnest(ls) as t from l)
select corpus_id, path, i::int as line, length(regexp_extract(t, '^(#{1,6})[ \t]+\S', 1))::int as depth, trim(regexp_extract(t, '^#{1,6}[ \t]+(\S.*)$', 1)) as title from e where regexp_matches(t, '^#{1,6}[ \t]+\S')""",
    "file_imports": _LAST + r""", f as (select corpus_id, path, unnest(case lang when 'python' then list_concat(regexp_extract_all(content, '(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 1), regexp_extract_all(content, '(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 2))
 when 'javascript' then regexp_extract_all(content, '(?:from|require\()\s*[''"]([^''"]+)[''"]', 1) when 'typescript' then regexp_extract_all(content, '(?:from|require\()\s*[''"]([^''"]+)[''"]', 1)
 when 'go' then regexp_extract_all(content, '(?m)^import\s+"([^"]+)"', 1) when 'rust' then regexp_extract_all(content, '(?m)^\s*use\s+([\w:]+)', 1) when 'java' then regexp_extract_all(content, '(?m)^import\s+(?:static\s+)?([\w.]+);', 1) end) as target from last where content is not null)
select target, count(*) as files, count(distinct corpus_id) as corpora from (select distinct * from f where target <> '') group by target""",
    "file_changes": "select corpus_id, change, count(*) as rows from (select corpus_id, case when row_number() over w = 1 then 'new' when lag(hash) over w is not distinct from hash then 'same' else 'changed' end as change from source_files window w as (partition by corpus_id, path order by indexed_at, hash)) group by 1, 2",
    "file_folders": _LAST + ", p as (select corpus_id, tokens, string_split(path, '/') as x from last), e as (select corpus_id, tokens, x, unnest(range(1, len(x))) as i from p) select corpus_id, array_to_string(x[1:i], '/') as folder, count(*) as files, sum(tokens)::bigint as tokens from e group by 1, 2",
    "file_copies": _LAST + "select md5(content) as md5, count(*) as files, count(distinct corpus_id) as corpora, min(corpus_id || ':' || path) as first_file from last where content is not null group by 1 having count(*) > 1",
    "file_coverage": _LAST + "select corpus_id, count(i) as indexed, count(e) as embedded, count(*) - count(e) as not_embedded, count(*) - count(i) as not_indexed from (select corpus_id, path as file_id, 1 as i from last) full join (select distinct corpus_id, file_id, 1 as e from embedding_entries) using (corpus_id, file_id) group by corpus_id",
    "doc_copies": "select md5(text) as md5, count(*) as docs, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1",
    "doc_sources": "select source, doc_type, count(*) as docs, sum(n_chars)::bigint as chars, count(*) filter (n_chars <> length(text)) as wrong_counts, count(*) filter (text is null) as null_texts from documents group by 1, 2",
    "doc_refs": r"""with r as (select doc_id, unnest(regexp_extract_all(text, '\[\[([^\]\[]+)\]\]', 1)) as r from documents), s as (select doc_id, regexp_replace(regexp_replace(lower(split_part(split_part(r, '|', 1), '#', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as t from r),
k as (select distinct regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as t from documents where title is not null)
select case when s.t = '' then 'untitled' else s.t end as target, count(*) as refs, count(distinct doc_id) as docs, bool_or(case when s.t = '' then 'untitled' else s.t end in (select case when t = '' then 'untitled' else t end from k)) as "exists" from s group by 1""",
    "doc_pages": r"""with f as (select doc_id, regexp_extract(text, '^---\r?\n([\s\S]*?)\r?\n---\r?\n', 1) as front from documents), g as (select doc_id, nullif(trim(regexp_extract(front, '(?m)^id:[ \t]*([^\r\n]*)', 1)), '') as page_id, nullif(trim(regexp_extract(front, '(?m)^kind:[ \t]*([^\r\n]*)', 1)), '') as kind,
 try_cast(nullif(trim(regexp_extract(front, '(?m)^confidence:[ \t]*([^\r\n]*)', 1)), '') as double) as confidence from f where front <> '')
select *, array_to_string(list_filter([case when page_id is null then 'id' end, case when coalesce(kind, '') not in ('entity', 'decision', 'concept', 'code') then 'kind' end, case when not coalesce(confidence between 0 and 1, false) then 'confidence' end], lambda x: x is not null), ',') as broken from g""",
}
