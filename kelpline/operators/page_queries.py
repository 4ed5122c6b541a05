"""Queries over pages, references, quotas and shared symbols, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import entities as E
from kelpline.operators import files as X
from kelpline.operators import ranking as K
from kelpline.operators import retrieval as R
from kelpline.operators import structure as S
from kelpline.operators.entity_queries import _CUR
from kelpline.operators.ranking_queries import KEYWORD, _keyword
from kelpline.operators.structure_queries import _EXPORTS, _LAST, _ROLES, _last
from kelpline.plans.joins import salted_join
from kelpline.session import stored
from kelpline.tables import table

NOW = "2026-11-01 00:00:00"
#: Days after which half of a page's freshness is gone, by what it was made from.
HALF_LIFE = {"wiki": 180, "note": 90, "call": 30, "mail": 30, "readme": 365}
OTHER_HALF_LIFE = 90


def doc_find(spark, sf_dir):
    """Wiki pages and notes that hold a word in title or text, titles first."""
    docs = table(spark, sf_dir, "documents").filter("doc_type in ('wiki', 'note')")
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("radar")), F.lit(False))
    return docs.withColumn("in_title", has("title")).filter(F.col("in_title") | has("text")).select("doc_id", "source", "in_title").orderBy(F.desc("in_title"), "doc_id").limit(100)


def doc_budget(spark, sf_dir):
    """The oldest pages of each source, as many as 20 000 characters hold. Sums are taken over what at most that many characters leave."""
    docs = table(spark, sf_dir, "documents").filter("n_chars > 0 and doc_type = 'wiki'").select("source", "doc_id", "created_at", F.col("n_chars").cast("bigint").alias("n_chars"))
    w = Window.partitionBy("source").orderBy("created_at", "doc_id")
    return docs.withColumn("used", F.sum("n_chars").over(w)).filter("used <= 20000").select("source", "doc_id", "used")


def doc_freshness(spark, sf_dir):
    """Documents by type and how fresh they are: 1 at once, 0 after two half-lives of their type."""
    half = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in HALF_LIFE.items() for x in pair]), F.col("doc_type")), F.lit(OTHER_HALF_LIFE))
    days = F.greatest((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400_000_000.0), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - days / (2.0 * half))
    state = F.when(score.isNull(), "unknown").when(score < 0.3, "stale").when(score < 0.7, "aging").otherwise("fresh")
    return table(spark, sf_dir, "documents").groupBy("doc_type", state.alias("state")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.round(score, 6)) + 1e-9, 5).alias("mean"))


def doc_expand(spark, sf_dir):
    """What a wiki page's references reach: the documents whose title bears the name, and how many those refer to in turn."""
    docs = table(spark, sf_dir, "documents")
    refs = stored(docs.select("doc_id", F.explode(T.wikirefs(F.col("text"))).alias("r")).select("doc_id", T.slug(F.col("r.target")).alias("target")).distinct(), "refs")
    titles = stored(docs.filter("title is not null").select(T.slug(F.col("title")).alias("target"), F.col("doc_id").alias("found")), "titles")
    named = titles.groupBy("target").agg(F.count(F.lit(1)).alias("docs"), F.min("found").alias("first_doc"))
    further = salted_join(titles, refs.groupBy(F.col("doc_id").alias("found")).agg(F.count(F.lit(1)).alias("n")), ["found"], "inner", F.col("target")).groupBy("target").agg(F.sum("n").alias("further"))
    asked = refs.groupBy("target").agg(F.count(F.lit(1)).alias("pages"))
    return asked.join(named, "target", "left").join(further, "target", "left").select("target", "pages", F.coalesce("docs", F.lit(0)).alias("docs"), "first_doc", F.coalesce("further", F.lit(0)).alias("further"))


def ent_slugs(spark, sf_dir):
    """Slugs of first names that several entities of a kind would share, and the suffix that the last of them needs."""
    rows = E.current(table(spark, sf_dir, "entities")).filter(F.size("names") > 0).select("kind", "id", T.slug(F.col("names")[0]).alias("slug"))
    return rows.groupBy("kind", "slug").agg(F.count(F.lit(1)).alias("ids"), F.max("id").alias("last_id")).filter("ids > 1").withColumn("last_slug", F.concat_ws("-", "slug", F.col("ids").cast("string")))


def symbol_pairs(spark, sf_dir):
    """Pairs of corpora that export the same names. A name meets once per corpus, and the corpora are few."""
    names = stored(S.exported(_last(spark, sf_dir, "content")).select("corpus_id", "name").distinct(), "names")
    other = names.withColumnRenamed("corpus_id", "other")
    return names.join(other, "name").filter("corpus_id < other").groupBy("corpus_id", "other").agg(F.count(F.lit(1)).alias("shared"), F.min("name").alias("first_name"))


def symbol_top(spark, sf_dir):
    """At most three exported names of each file, in the order of the names, and how many are left out."""
    names = S.exported(_last(spark, sf_dir, "content")).distinct()
    listed = names.groupBy("corpus_id", "path").agg(F.array_sort(F.collect_list("name")).alias("n"))  # one file's names
    return listed.select("corpus_id", "path", F.array_join(F.slice("n", 1, 3), ",").alias("names"), F.greatest(F.size("n") - 3, F.lit(0)).alias("left_out"))


def symbol_comments(spark, sf_dir):
    """Python symbols with a docstring or a comment line above, per corpus."""
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    files = _last(spark, sf_dir, "content").filter("ext = 'py' and content is not null").select("corpus_id", lines.alias("ls"))
    each = files.select("corpus_id", F.explode(F.transform("ls", lambda l, i: F.struct(l.alias("line"), F.when(i > 0, F.element_at("ls", i)).alias("above"), F.try_element_at("ls", i + 2).alias("below")))).alias("x")).select("corpus_id", "x.*")
    symbols = each.filter(F.col("line").rlike(r"^\s*(?:class|(?:async\s+)?def)\s+\w+"))
    above, below = F.coalesce(F.col("above").rlike(r"^\s*#"), F.lit(False)), F.coalesce(F.col("below").rlike(r"""^\s*(\"\"\"|''')"""), F.lit(False))
    return symbols.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(above).alias("commented"), F.count_if(below).alias("documented"))


def find_quota(spark, sf_dir):
    """10 000 tokens shared out to the corpora by how much their files found by keywords are relevant together, 200 at least."""
    sums = stored(_keyword(spark, sf_dir).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("relevance"), 4).alias("weight")), "weights")
    all_ = sums.agg(F.sum("weight").alias("all"))
    return sums.crossJoin(F.broadcast(all_)).select("corpus_id", "files", "weight", F.greatest(F.floor(F.col("weight") * 10_000 / F.col("all") + 1e-9), F.lit(200)).alias("quota"))  # all_ is one row


def file_doubles(spark, sf_dir):
    """Paths that stand in several corpora, with the rows that later ones replaced."""
    rows = table(spark, sf_dir, "source_files")
    return rows.groupBy("path").agg(F.countDistinct("corpus_id").alias("corpora"), F.count(F.lit(1)).alias("rows"), F.countDistinct("hash").alias("contents")).filter("corpora > 1 or rows > 1")


def run_hypotheses(spark, sf_dir):
    """Per pair of mode and rerank: whether recall reaches a half, precision a fifth, and failures stay under a tenth."""
    runs = R.distinct_runs(table(spark, sf_dir, "retrieval_runs"))
    m = R.metrics(runs)
    ok = F.col("error").isNull() & (F.col("n_truth") > 0)
    g = m.groupBy("mode", "rerank").agg(F.count(F.lit(1)).alias("runs"), F.avg(F.when(ok, F.col("recall"))).alias("r"), F.avg(F.when(ok, F.col("precision_k"))).alias("p"), F.avg(F.col("error").isNotNull().cast("int")).alias("f"))
    return g.select("mode", "rerank", "runs", F.coalesce(F.col("r") >= 0.5, F.lit(False)).alias("recall_holds"), F.coalesce(F.col("p") >= 0.2, F.lit(False)).alias("precision_holds"), (F.col("f") < 0.1).alias("few_failures"))


QUERIES = {f.__name__: f for f in [doc_find, doc_budget, doc_freshness, doc_expand, ent_slugs, symbol_pairs, symbol_top, symbol_comments, find_quota, file_doubles, run_hypotheses]}

_SLUG = lambda c: f"coalesce(nullif(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"

SQL = {
    "doc_find": "select doc_id, source, coalesce(contains(lower(title), 'radar'), false) as in_title from documents where doc_type in ('wiki', 'note') and (contains(lower(title), 'radar') or contains(lower(text), 'radar')) order by 3 desc, 1 limit 100",
    "doc_budget": "select source, doc_id, used::bigint as used from (select source, doc_id, sum(n_chars) over (partition by source order by created_at, doc_id) as used from documents where n_chars > 0 and doc_type = 'wiki') where used <= 20000",
    "doc_freshness": f"with s as (select doc_type, case when created_at is not null then greatest(0, 1 - greatest((epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400000000.0::double, 0) / (2.0::double * case doc_type when 'wiki' then 180 when 'note' then 90 when 'call' then 30 when 'mail' then 30 when 'readme' then 365 else 90 end)) end as s from documents) select doc_type, case when s is null then 'unknown' when s < 0.3 then 'stale' when s < 0.7 then 'aging' else 'fresh' end as state, count(*) as docs, round(avg(round(s, 6)) + 1e-9, 5) as mean from s group by 1, 2",
    "doc_expand": rf"""with r as (select distinct doc_id, {_SLUG("split_part(split_part(r, '|', 1), '#', 1)")} as target from (select doc_id, unnest(regexp_extract_all(text, '\[\[([^\]\[]+)\]\]', 1)) as r from documents)), t as (select {_SLUG('title')} as target, doc_id from documents where title is not null), n as (select doc_id, count(*) as n from r group by 1)
select a.target, a.pages, coalesce(b.docs, 0) as docs, b.first_doc, coalesce(b.further, 0)::bigint as further from (select target, count(*) as pages from r group by 1) a left join (select target, count(*) as docs, min(t.doc_id) as first_doc, sum(n.n) as further from t left join n using (doc_id) group by 1) b using (target)""",
    "ent_slugs": _CUR + f", s as (select kind, id, {_SLUG('names[1]')} as slug from cur where len(names) > 0) select kind, slug, count(*) as ids, max(id) as last_id, slug || '-' || count(*)::varchar as last_slug from s group by 1, 2 having count(*) > 1",
    "symbol_pairs": f"with {_ROLES}, {_EXPORTS}, d as (select distinct corpus_id, name from x) select a.corpus_id, b.corpus_id as other, count(*) as shared, min(name) as first_name from d a join d b using (name) where a.corpus_id < b.corpus_id group by 1, 2",
    "symbol_top": f"with {_ROLES}, {_EXPORTS}, d as (select corpus_id, path, list_sort(list(distinct name)) as n from x group by 1, 2) select corpus_id, path, array_to_string(n[1:3], ',') as names, greatest(len(n) - 3, 0)::int as left_out from d",
    "symbol_comments": f"with {_ROLES}, " + r"""e as (select corpus_id, path, generate_subscripts(ls, 1) as i, unnest(ls) as l from (select corpus_id, path, regexp_split_to_array(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n') as ls from roles where ext = 'py' and content is not null)),
w as (select *, lag(l) over v as above, lead(l) over v as below from e window v as (partition by corpus_id, path order by i))
select corpus_id, count(*) as symbols, count(*) filter (regexp_matches(above, '^\s*#')) as commented, count(*) filter (regexp_matches(below, '^\s*("{3}|''{3})')) as documented from w where regexp_matches(l, '^\s*(?:class|(?:async\s+)?def)\s+\w+') group by 1""",
    "find_quota": f"with {KEYWORD}, s as (select corpus_id, count(*) as files, round(sum(relevance), 4) as weight from k group by 1) select corpus_id, files, weight, greatest(floor(weight * 10000 / sum(weight) over () + 1e-9), 200)::bigint as quota from s",
    "file_doubles": "select path, count(distinct corpus_id) as corpora, count(*) as rows, count(distinct hash) as contents from source_files group by 1 having count(distinct corpus_id) > 1 or count(*) > 1",
    "run_hypotheses": """with d as (select distinct on (run_id) * from retrieval_runs), x as (select mode, rerank, error, top_k, list_distinct(list_transform(list_filter(coalesce(ground_truth, []), lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', ''))) as t, list_transform(list_filter(coalesce(retrieved, []), lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', '')) as g from d),
m as (select *, case when error is null and len(t) > 0 then len(list_intersect(g, t))::double / len(t) end as r, case when error is null and len(t) > 0 then case when top_k > 0 then len(list_filter(g[1:greatest(top_k, 1)], lambda p: list_contains(t, p)))::double / top_k else 0 end end as p from x)
select mode, rerank, count(*) as runs, coalesce(avg(r) >= 0.5, false) as recall_holds, coalesce(avg(p) >= 0.2, false) as precision_holds, avg(case when error is not null then 1.0::double else 0 end) < 0.1 as few_failures from m group by 1, 2""",
}
