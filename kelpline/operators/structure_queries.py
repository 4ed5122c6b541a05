"""Queries over the structure of files and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import files as X
from kelpline.operators import graph as G
from kelpline.operators import structure as S
from kelpline.session import stored
from kelpline.tables import table


def _last(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return S.with_roles(X.latest(table(spark, sf_dir, "source_files").select("corpus_id", "path", "indexed_at", "hash", "tokens", *columns)))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(_last(spark, sf_dir).select("corpus_id", "path", "is_test", "is_doc", "is_code"), "roles")
    return S.weighted(S.test_links(files).unionByName(S.doc_links(files)))


def file_roles(spark, sf_dir):
    """Files and tokens by language and role."""
    return _last(spark, sf_dir).groupBy("language", "is_test", "is_doc", "is_code", "indexable").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))


def file_tree(spark, sf_dir):
    return S.heading_tree(_last(spark, sf_dir, "headings"))


def file_tree_totals(spark, sf_dir):
    """Of each corpus: headings, the deepest one, and the tokens under headings of the top."""
    t = S.heading_tree(_last(spark, sf_dir, "headings"))
    return t.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"), F.sum(F.when(F.col("parent") == -1, F.col("total")).otherwise(0)).alias("tokens"))


def file_sections(spark, sf_dir):
    rows = _last(spark, sf_dir, "content").filter("is_doc and content is not null")
    return rows.select("corpus_id", "path", F.posexplode(S.sections(F.col("content"))).alias("at", "s")).select("corpus_id", "path", "at", "s.title", "s.chars")


def doc_leads(spark, sf_dir):
    """First sentence and first paragraph of each document."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("t", F.regexp_replace("text", "\r\n?", "\n"))
    return docs.select("doc_id", F.md5(S.first_sentence(F.col("t"))).alias("sentence_md5"), F.length(S.first_paragraph(F.col("t"))).alias("paragraph_chars"))


def file_exports(spark, sf_dir):
    """Exported names that several files have."""
    names = S.exported(_last(spark, sf_dir, "content"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("exports"), F.countDistinct("corpus_id").alias("corpora")).filter("exports > 1")


def symbol_resolved(spark, sf_dir):
    """Which files the names that are used most as parts of symbols resolve to, strictly if there is one."""
    names = stored(S.exported(_last(spark, sf_dir, "content")).distinct(), "names")
    return S.resolved(names.select("name").distinct(), names)


def symbol_lines(spark, sf_dir):
    return S.symbol_lines(_last(spark, sf_dir, "content"))


def symbol_at_line(spark, sf_dir):
    """The innermost Python symbol around each line that returns."""
    files = stored(_last(spark, sf_dir, "content").filter("ext = 'py' and content is not null"), "python")
    lines = F.transform(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n"), lambda l, i: F.when(l.rlike(r"^\s*return\b"), i + 1))
    asked = files.select("corpus_id", "path", F.explode(lines).alias("line")).filter("line is not null")
    return S.innermost(S.symbol_lines(files), asked)


def link_kinds(spark, sf_dir):
    """Links between files by corpus and kind."""
    return _links(spark, sf_dir).groupBy("corpus_id", "kind", "weight").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def link_hubs(spark, sf_dir):
    """Links between files with the weights of hubs damped: the weight that each target draws."""
    named = _links(spark, sf_dir).select(F.concat_ws(":", "corpus_id", "source").alias("source"), F.concat_ws(":", "corpus_id", "target").alias("target"), "kind", "weight")
    return G.damped(named).groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("weight"), 4).alias("weight"))


def link_quota(spark, sf_dir):
    """The twenty best of each corpus: files found by keywords keep sixteen places, the rest go to files that are only linked to them."""
    from pyspark.sql import Window

    found = stored(X.keyword_scored(_last(spark, sf_dir, "headings"), "vessel signal ranking schema").filter("relevance > 0").select("corpus_id", "path", "relevance"), "found")
    links = stored(_links(spark, sf_dir), "links")
    reached = links.join(found.withColumnRenamed("path", "source"), ["corpus_id", "source"]).groupBy("corpus_id", F.col("target").alias("path")).agg(F.round(F.max(F.col("relevance") * F.col("weight") * G.DECAY), 6).alias("relevance"))
    only = reached.filter("relevance >= 0.05").join(found.select("corpus_id", "path"), ["corpus_id", "path"], "left_anti").withColumn("by", F.lit("link"))
    w = Window.partitionBy("corpus_id", "by").orderBy(F.desc("relevance"), "path")
    ranked = found.withColumn("by", F.lit("keyword")).unionByName(only).withColumn("r", F.row_number().over(w)).filter("r <= 20")
    n = ranked.groupBy("corpus_id").agg(F.count_if(F.col("by") == "keyword").alias("nk"), F.count_if(F.col("by") == "link").alias("nl"))
    keep = F.when((F.col("nl") > 0) & (F.col("nk") >= 20), 20 - F.least("nl", F.lit(4))).otherwise(F.least("nk", F.lit(20)))
    return ranked.join(n, "corpus_id").filter(F.when(F.col("by") == "keyword", F.col("r") <= keep).otherwise(F.col("r") <= 20 - keep)).select("corpus_id", "by", "path", "relevance", "r")


def file_page(spark, sf_dir):
    """The third page of fifty files, the largest first."""
    rows = _last(spark, sf_dir).select("corpus_id", "path", "tokens", (-F.col("tokens")).alias("less"))
    return S.page(rows, ["less", "corpus_id", "path"], 3, 50).select("corpus_id", "path", "tokens", "at")


QUERIES = {f.__name__: f for f in [file_roles, file_tree, file_tree_totals, file_sections, doc_leads, file_exports, symbol_resolved, symbol_lines, symbol_at_line, link_kinds, link_hubs, link_quota, file_page]}

from kelpline.operators.ranking_queries import KEYWORD  # noqa: E402

_LAST = "last as (select * exclude (_r) from (select *, row_number() over (partition by corpus_id, path order by indexed_at desc, hash desc nulls last, tokens desc) as _r from source_files) where _r = 1)"
_ROLES = _LAST + r""",
g as (select *, lower(regexp_extract(path, '\.([^./]+)$', 1)) as ext, lower(regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1)) as base from last),
roles as (select *, case when ext = 'py' then 'python' when ext in ('ts', 'tsx') then 'typescript' when ext in ('js', 'jsx', 'mjs') then 'javascript' when ext = 'go' then 'go' when ext = 'rs' then 'rust' when ext = 'java' then 'java' when ext in ('md', 'mdx') then 'markdown' when ext = 'rst' then 'rst' when ext = 'txt' then 'text' when ext = 'json' then 'json' when ext in ('yaml', 'yml') then 'yaml' when ext = 'css' then 'css' when ext = 'html' then 'html' when ext = 'sh' then 'shell' else 'other' end as language,
 regexp_matches(path, '\.test\.[tj]sx?$|\.spec\.[tj]sx?$|__tests__/|test_\w+\.py$|\w+_test\.py$|^tests?/') as is_test, ext in ('md', 'mdx', 'rst', 'txt') as is_doc, ext in ('ts', 'tsx', 'js', 'jsx', 'mjs', 'py', 'rs', 'go') as is_code,
 regexp_matches(path, 'node_modules/|\.git/|dist/|build/|\.next/|__pycache__/|\.cache/|coverage/|\.turbo/|package-lock\.json$|yarn\.lock$|pnpm-lock\.yaml$|\.min\.(js|css)$|\.map$|\.d\.ts$|\.png$|\.jpg$|\.jpeg$|\.gif$|\.svg$|\.ico$|\.woff|\.ttf|\.eot') as skipped from g)"""
_TREE = _LAST + """, h as (select corpus_id, path, generate_subscripts(headings, 1) - 1 as node, unnest(headings) as x from last where len(headings) > 0), hh as (select corpus_id, path, node, x.depth as depth, x.title as title, x.tokens as tokens from h),
tree as (select a.*, coalesce((select max(b.node) from hh b where b.corpus_id = a.corpus_id and b.path = a.path and b.node < a.node and b.depth < a.depth), -1) as parent,
 (select sum(c.tokens) from hh c where c.corpus_id = a.corpus_id and c.path = a.path and c.node >= a.node and not exists (select 1 from hh d where d.corpus_id = a.corpus_id and d.path = a.path and d.node > a.node and d.node <= c.node and d.depth <= a.depth)) as total from hh a)"""
_LINKS = _ROLES + r""", tn as (select corpus_id, path, regexp_replace(regexp_replace(regexp_replace(base, '\.(test|spec)$', ''), '^test[_-]', ''), '[_-]test$', '') as name from roles where is_test),
tl as (select t.corpus_id, t.path as test, c.path as code from tn t join roles c on c.corpus_id = t.corpus_id and c.is_code and c.base = t.name and c.path <> t.path),
pn as (select corpus_id, path, is_doc, is_code, replace(replace(base, '-', ''), '_', '') as name from roles where is_doc or is_code),
dl as (select d.corpus_id, d.path as doc, c.path as code from pn d join pn c on c.corpus_id = d.corpus_id and d.is_doc and c.is_code and d.name <> '' and c.name <> '' and (contains(c.name, d.name) or contains(d.name, c.name))),
links as (select corpus_id, test as source, code as target, 'tests' as kind, 0.6::double as weight from tl union all select corpus_id, code, test, 'tested_by', 0.6 from tl union all select distinct corpus_id, doc, code, 'documents', 0.5 from dl)"""
_PY = r"""py as (select corpus_id, path, regexp_split_to_array(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n') as ls from roles where ext = 'py' and content is not null), e as (select corpus_id, path, generate_subscripts(ls, 1) as line, unnest(ls) as l from py),
n as (select corpus_id, path, line, l, length(regexp_extract(l, '^([ \t]*)\S', 1)) as indent, regexp_extract(l, '^[ \t]*(?:class|(?:async\s+)?def)\s+(\w+)', 1) as name from e where trim(l) <> ''),
sym as (select a.corpus_id, a.path, a.name, a.line as first, coalesce((select min(b.line) - 1 from n b where b.corpus_id = a.corpus_id and b.path = a.path and b.line > a.line and b.indent <= a.indent), (select max(b.line) from n b where b.corpus_id = a.corpus_id and b.path = a.path)) as last from n a where a.name <> '')"""
_EXPORTS = r"""x as (select corpus_id, path, unnest(case when ext = 'py' then regexp_extract_all(content, '(?m)^(?:class|(?:async\s+)?def)\s+(\w+)', 1) when ext in ('ts', 'tsx', 'js', 'jsx', 'mjs') then regexp_extract_all(content, '(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:declare\s+)?(?:(?:abstract\s+)?class|interface|type|enum|function|(?:const|let|var))\s+(\w+)', 1) end) as name from roles where content is not null)"""

SQL = {
    "file_roles": f"with {_ROLES} select language, is_test, is_doc, is_code, not skipped and language <> 'other' as indexable, count(*) as files, sum(tokens)::bigint as tokens from roles group by all",
    "file_tree": f"with {_TREE} select corpus_id, path, node::int as node, depth, title, parent::int as parent, tokens, total::bigint as total from tree",
    "file_tree_totals": f"with {_TREE} select corpus_id, count(*) as nodes, max(depth) as deepest, sum(case when parent = -1 then total else 0 end)::bigint as tokens from tree group by 1",
    "file_sections": f"with {_ROLES}, " + r"""l as (select corpus_id, path, regexp_split_to_array(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n') as ls from roles where is_doc and content is not null), e as (select corpus_id, path, generate_subscripts(ls, 1) as i, unnest(ls) as l from l),
s as (select *, sum(case when regexp_matches(l, '^#{1,6}[ \t]+\S') then 1 else 0 end) over (partition by corpus_id, path order by i) as k from e)
select corpus_id, path, (k - 1)::int as at, trim(regexp_extract(min_by(l, i), '^#{1,6}[ \t]+(.*)$', 1)) as title, length(regexp_replace(coalesce(string_agg(l, chr(10) order by i) filter (not regexp_matches(l, '^#{1,6}[ \t]+\S')), ''), '^\s+|\s+$', '', 'g')) as chars from s where k > 0 group by corpus_id, path, k""",
    "doc_leads": r"""with t as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t from documents where text is not null), f as (select doc_id, t, regexp_extract(t, '^[^\n]*?[.!?](?:\s|$)') as f from t)
select doc_id, md5(left(case when f <> '' then regexp_replace(f, '^\s+|\s+$', '', 'g') else split_part(t, chr(10), 1) end, 200)) as sentence_md5, length(left(regexp_replace(split_part(t, chr(10) || chr(10), 1), '^\s+|\s+$', '', 'g'), 500))::int as paragraph_chars from f""",
    "file_exports": f"with {_ROLES}, {_EXPORTS} select name, count(*) as exports, count(distinct corpus_id) as corpora from x group by 1 having count(*) > 1",
    "symbol_resolved": f"with {_ROLES}, {_EXPORTS} select name, count(*) as files, min(corpus_id || ':' || path) as first_file, count(*) = 1 as strict from (select distinct * from x) group by 1",
    "symbol_lines": f"with {_ROLES}, {_PY} select corpus_id, path, name, first::int as first, last::int as last from sym",
    "symbol_at_line": f"with {_ROLES}, {_PY} select r.corpus_id, r.path, r.line::int as line, max_by(s.name, s.first) as name from n r join sym s on s.corpus_id = r.corpus_id and s.path = r.path and r.line between s.first and s.last where regexp_matches(r.l, '^\\s*return\\b') group by 1, 2, 3",
    "link_kinds": f"with {_LINKS} select corpus_id, kind, weight, count(*) as links, count(distinct source) as sources, count(distinct target) as targets from links group by 1, 2, 3",
    "link_hubs": f"with {_LINKS}, d as (select *, count(*) over (partition by corpus_id, target, kind) as n from links) select corpus_id || ':' || target as target, count(*) as links, round(sum(round(case when n > 10 then weight / (1 + log2(n / 10.0::double)) else weight end, 6)), 4) as weight from d group by 1",
    "link_quota": f"with {_LINKS}, {KEYWORD.replace(_LAST + ',', '', 1)}, reach as (select l.corpus_id, l.target as path, round(max(k.relevance * l.weight * 0.65::double), 6) as relevance from links l join k on k.corpus_id = l.corpus_id and k.path = l.source group by 1, 2)"
    """, every as (select corpus_id, path, relevance, 'keyword' as "by" from k union all select corpus_id, path, relevance, 'link' from reach r where relevance >= 0.05 and not exists (select 1 from k where k.corpus_id = r.corpus_id and k.path = r.path)),
ranked as (select *, row_number() over (partition by corpus_id, "by" order by relevance desc, path)::int as r from every), n as (select corpus_id, least(20, count(*) filter ("by" = 'keyword')) as nk, least(20, count(*) filter ("by" = 'link')) as nl from every group by 1)
select corpus_id, "by", path, relevance, r from ranked join n using (corpus_id) where case when "by" = 'keyword' then r <= case when nl > 0 and nk >= 20 then 20 - least(nl, 4) else nk end else r <= 20 - case when nl > 0 and nk >= 20 then 20 - least(nl, 4) else nk end end""",
    "file_page": f"""with {_LAST} select corpus_id, path, tokens, n::int as "at" from (select *, row_number() over (order by tokens desc, corpus_id, path) as n from last) where n between 101 and 150""",
}
