"""Queries over the vector store, run texts, page rules, risks and entity packing, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import vectors as V
from kelpline.operators import entities as E
from kelpline.operators import files as X
from kelpline.operators import graph as G
from kelpline.operators import ranking as K
from kelpline.operators import retrieval as R
from kelpline.operators.entity_queries import _CUR
from kelpline.plans.joins import broadcast_if_small
from kelpline.session import stored
from kelpline.tables import table

NOW = "2026-11-01 00:00:00"
#: What a page must say, its kinds, and what a decision must say besides.
PAGE_KEYS = ["id", "kind", "title", "slug", "scope", "sources", "confidence", "updated", "last_verified_at", "schema_version"]
PAGE_KINDS = ["concept", "component", "decision", "actor", "process", "metric", "code"]
DECISION_KEYS = ["supersedes", "superseded_by", "valid_until"]
#: Words of a query by the task they tell, the first that fits.
TASKS = {"fix": "fix|bug|error|crash|broken|issue", "research": r"\bresearch\b|find|look.*up|what.*about", "review": r"\breview\b|pr\b|pull request|diff|changes", "explain": "explain|how does|what is|understand|walk.*through", "build": "add|build|create|implement|feature|new", "document": "document|readme|write.*doc|api.*doc"}
#: How much a kind of what refers counts, any other kind, and the least that freshness counts.
RISKS = {"decision": 1.0, "component": 0.9, "concept": 0.8, "code": 0.7, "actor": 0.6, "process": 0.6, "metric": 0.6}
OTHER_RISK, LEAST_FRESH = 0.6, 0.3
#: The share of an item's tokens at each depth, from whole to a mention.
DEPTHS = [1.0, 0.40, 0.20, 0.08, 0.03]
#: Entries and queries of a corpus that meet at a time, and how many of their scores are held at once.
BLOCK, ASKED, SCORES = 1 << 15, 1 << 12, 1 << 22


def _asked(spark: SparkSession, sf_dir: str, by: str, pool: int, k: int = 10) -> DataFrame:
    """(corpus_id, entry_id, other, exact, score): each entry whose id is divisible by 100 against all of its corpus: cosine, and its cosine of the first half (by = short) or product with the signs.

    Entries meet queries in blocks, as matrices. Of a block only pairs leave it that are among
    its k best by cosine or its `pool` best by score for their query, ties to the smaller id:
    all that can be so in the whole corpus.
    """
    usable = R.usable_entries(table(spark, sf_dir, "embedding_entries")).filter("corpus_id is not null and entry_id is not null")
    entries = stored(usable.select("corpus_id", "entry_id", "embedding"), "entries")
    parts = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    sizes = entries.groupBy("corpus_id").agg(parts(F.count(F.lit(1)), BLOCK).alias("blocks"), parts(F.count_if(F.expr("entry_id % 100 = 0")), ASKED).alias("turns")).filter("turns > 0")
    sized = entries.join(broadcast_if_small(stored(sizes, "sizes")), "corpus_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("entry_id"), F.col(n)).cast("int")
    keys = ["corpus_id", "block", "turn"]
    held = sized.select("corpus_id", at("blocks").alias("block"), each("turns").alias("turn"), F.col("entry_id").alias("other"), "embedding")
    asked = sized.filter("entry_id % 100 = 0").select(F.col("corpus_id").alias("corpus_id"), each("blocks").alias("block"), at("turns").alias("turn"), "entry_id", F.col("embedding").alias("q"))

    def run(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(held) and len(asked):
            held = held.sort_values("other", kind="stable")
            ids, asks, v, q = held["other"].to_numpy(), asked["entry_id"].to_numpy(), np.stack(held["embedding"].to_list()), np.stack(asked["q"].to_list())
            u, qu = of_length_one(v), of_length_one(q)
            w, qw = (of_length_one(v[:, :32]), of_length_one(q[:, :32])) if by == "short" else (np.where(v >= 0, 1.0, -1.0), q)
            own = list(zip(np.searchsorted(ids, asks), np.searchsorted(ids, asks, "right")))
            step = max(1, SCORES // len(ids))
            for i in range(0, len(asks), step):
                exact, score = (a[i : i + step] @ b.T for a, b in ((qu, u), (qw, w)))
                keep = np.union1d(best(exact, k, own[i : i + step]), best(score, pool, own[i : i + step]))
                x, y = np.divmod(keep, len(ids))
                out.append((asks[i + x], ids[y], rounded(exact.ravel()[keep]), rounded(score.ravel()[keep])))
        entry_id, other, exact, score = map(np.concatenate, zip(*out))
        return pd.DataFrame({"corpus_id": key[0], "entry_id": entry_id, "other": other, "exact": exact, "score": score})

    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "corpus_id string, entry_id bigint, other bigint, exact double, score double")


def of_length_one(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without length become NaN, as their cosine is in SQL."""
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=np.full_like(v, np.nan), where=n != 0)


def rounded(s: np.ndarray) -> np.ndarray:
    """s as off_half rounds it; NaN, the largest for Spark and SQL, becomes infinite, as pandas would make it null."""
    return np.nan_to_num(np.rint((s + 1e-9) * 1e6) / 1e6, nan=np.inf, posinf=np.finfo(float).max, neginf=np.finfo(float).min)


def best(s: np.ndarray, k: int, own: list[tuple[int, int]]) -> np.ndarray:
    """Flat places of the k largest of each row as rounded, ties to the first, without the row's own columns, which are overwritten.

    Rounding keeps the order, so the k-th largest tells which may be among them, and
    only those are rounded; if some scores are not finite, or too large to be rounded, all are.
    """
    order = s if -1e300 < s.min() and s.max() < 1e300 else rounded(s)
    for row, (a, b) in zip(order, own):
        row[a:b] = -np.inf
    n = s.shape[1]
    if n <= k:
        return np.flatnonzero(order > -np.inf)
    least = np.partition(order, n - k, axis=1)[:, n - k]
    if order is s:
        least = rounded(least)
        may = order >= (least - np.abs(least) * 1e-12 - 1e-6)[:, None]
    else:
        may = order >= least[:, None]
    at = np.flatnonzero(may)
    at = at[order.ravel()[at] > -np.inf]
    x, v = at // n, rounded(order.ravel()[at]) if order is s else order.ravel()[at]
    above, same = v > least[x], np.flatnonzero(v == least[x])
    of = x[same]
    place = np.arange(len(same)) - np.searchsorted(of, of)
    first = same[place < k - np.bincount(x[above], minlength=len(s))[of]]
    return np.concatenate([at[above], at[first]])


def _recall(pairs: DataFrame, by: Column, pool: int, k: int = 10) -> DataFrame:
    """Per corpus the share of the k nearest that are among the `pool` best by another score, ties to the smaller id."""
    place = lambda c: F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc(c), "other"))
    ranked = pairs.withColumn("t", place(F.col("exact"))).withColumn("p", place(by)).filter(F.col("t") <= k)
    return ranked.groupBy("corpus_id").agg(F.countDistinct("entry_id").alias("queries"), F.round(F.avg((F.col("p") <= pool).cast("int")) + 1e-9, 6).alias("recall")).withColumn("passed", F.col("recall") >= 0.98)


def vec_half_recall(spark, sf_dir):
    """Recall at 10 of vectors cut to their first half, and whether it drops by two percent at most."""
    return _recall(_asked(spark, sf_dir, "short", 10), F.col("score"), 10)


def vec_sign_recall(spark, sf_dir):
    """Recall at 10 when the hundred best by signs alone are ranked again by the whole vectors."""
    return _recall(_asked(spark, sf_dir, "signs", 100), F.col("score"), 100)


def vec_actions(spark, sf_dir):
    """What the entries do to a store of one vector a file, in the order in which they arrive: add, replace, the same again; and what goes with its file."""
    entries = table(spark, sf_dir, "embedding_entries")
    w = Window.partitionBy("corpus_id", "file_id").orderBy("ingested_at", "entry_id")
    changed = entries.select("corpus_id", "file_id", "entry_id", "ingested_at", "content_hash").withColumn("before", F.lag("content_hash").over(w)).withColumn("n", F.row_number().over(w))
    done = changed.select("corpus_id", F.when(F.col("n") == 1, "add").when(F.col("before").eqNullSafe(F.col("content_hash")), "same").otherwise("replace").alias("action"))
    gone = entries.select("corpus_id", "file_id").distinct().join(table(spark, sf_dir, "source_files").select("corpus_id", F.col("path").alias("file_id")).distinct(), ["corpus_id", "file_id"], "left_anti").select("corpus_id", F.lit("remove").alias("action"))
    return done.unionByName(gone).groupBy("corpus_id", "action").agg(F.count(F.lit(1)).alias("entries"))


def corpora_fingerprints(spark, sf_dir):
    """A fingerprint of each corpus that does not depend on the order of its files: the sum of hashes of paths and contents."""
    files = X.latest(table(spark, sf_dir, "source_files").select("corpus_id", "path", "hash", "indexed_at", "tokens"))
    part = F.conv(F.substring(F.md5(F.concat_ws("|", "path", F.coalesce("hash", F.lit("")))), 1, 12), 16, 10).cast("decimal(20,0)")
    return files.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("files"), F.sum(part).cast("string").alias("fingerprint"))


def run_tasks(spark, sf_dir):
    """Runs by the task that their query tells."""
    q = F.lower(F.coalesce("query_text", F.lit("")))
    task = F.lit("explain")
    for name, words in reversed(TASKS.items()):
        task = F.when(q.rlike(words), name).otherwise(task)
    return R.distinct_runs(table(spark, sf_dir, "retrieval_runs")).groupBy(task.alias("task"), "config").agg(F.count(F.lit(1)).alias("runs"))


def run_fuzzy(spark, sf_dir):
    """Recall and precision of each run where one path may hold the other or bear the same file name."""
    clean = lambda c: F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda p: p.isNotNull()), F.lower))
    runs = R.distinct_runs(table(spark, sf_dir, "retrieval_runs")).filter("error is null").select("run_id", clean(F.col("ground_truth")).alias("truth"), clean(F.col("retrieved")).alias("got"))
    name = lambda p: F.regexp_extract(p, "[^/]*$", 0)
    same = lambda a, b: F.contains(a, b) | F.contains(b, a) | (name(a) == name(b))
    share = lambda of, other: F.when(F.size(of) > 0, F.size(F.filter(of, lambda a: F.exists(other, lambda b: same(a, b)))) / F.size(of)).otherwise(0.0)
    return runs.select("run_id", K.off_half(share(F.col("truth"), F.col("got"))).alias("recall"), K.off_half(share(F.col("got"), F.col("truth"))).alias("precision"))


def doc_page_rules(spark, sf_dir):
    """The first rule that each kind of page with front matter breaks."""
    front = F.regexp_extract("text", r"\A---\s*\n([\s\S]*?)\n---\s*\n", 1)
    keys = F.regexp_extract_all("front", F.lit(r"(?m)^([A-Za-z_]\w*):"), 1)
    pages = table(spark, sf_dir, "documents").withColumn("front", front).filter("front <> ''").select("doc_id", keys.alias("keys"), F.trim(F.regexp_extract("front", r"(?m)^kind:[ \t]*([^\r\n]*)", 1)).alias("kind"))
    missing = lambda wanted: F.array_except(F.array(*map(F.lit, wanted)), F.col("keys"))
    rule = F.when(~F.array_contains("keys", "schema_version"), "schema_version").when(F.size(missing(PAGE_KEYS)) > 0, "missing keys").when(~F.col("kind").isin(PAGE_KINDS), "kind").when((F.col("kind") == "decision") & (F.size(missing(DECISION_KEYS)) > 0), "decision keys").otherwise("valid")
    return pages.groupBy("kind", rule.alias("rule"), F.array_join(F.array_sort(missing(PAGE_KEYS)), ",").alias("missing")).agg(F.count(F.lit(1)).alias("pages"))


def graph_risk(spark, sf_dir):
    """What refers to the last updated ten entities, by a risk that falls with hops, by kind and with age."""
    rows = E.current(table(spark, sf_dir, "entities"))
    changed = rows.orderBy(F.desc("updated_at"), "id").limit(10).select("id")
    hit = G.impact(G.entity_edges(rows), changed, 2)
    of = E.freshness(rows, F.lit(NOW).cast("timestamp")).select("id", "kind", "score")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in RISKS.items() for x in pair]), F.col("kind")), F.lit(OTHER_RISK))
    return hit.join(of, "id").select("id", "hops", F.round(F.col("risk") * kind * F.greatest(F.coalesce("score", F.lit(1.0)), F.lit(LEAST_FRESH)) + 1e-9, 5).alias("risk"))


def graph_limited(spark, sf_dir):
    """What the five most referred ids lead to by links alone, the thirty most relevant."""
    edges = G.entity_edges(E.current(table(spark, sf_dir, "entities"))).filter("kind = 'links_to'")
    start = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(5).select(F.col("target").alias("id"), F.lit(1.0).alias("relevance"))
    return G.traverse(edges, start, depth=2).orderBy(F.desc("relevance"), "id").limit(30)


def _at_depth(tokens: Column, depth: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(tokens * F.element_at(F.array(*map(F.lit, DEPTHS)), depth + 1)))


def packed_by_depth(rows: DataFrame, budget: int) -> DataFrame:
    """(id, via, depth, cost) of rows (id, via, rank, tokens, start) of one answer within the budget, depths from start on.

    What comes last goes down to a mention first, then what stands before it:
    one item stops where enough is saved, so depths follow from sums over the
    order. If mentions alone are too many, the head stays. What is left then
    lifts items from the head on, each as far as it goes.
    """
    w = Window.orderBy("rank")  # the rows of one answer
    r = rows.withColumn("full", _at_depth(F.col("tokens"), F.col("start"))).withColumn("least", _at_depth(F.col("tokens"), F.lit(4)))
    every = Window.partitionBy(F.lit(0))
    after = F.coalesce(F.sum(F.col("full") - F.col("least")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    r = r.withColumn("need", F.sum("full").over(every) - after - budget)
    steps = F.filter(F.sequence("start", F.lit(4)), lambda d: F.col("full") - _at_depth(F.col("tokens"), d) >= F.col("need"))
    r = r.withColumn("depth", F.when(F.col("need") <= 0, F.col("start")).otherwise(F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit(4))))
    r = r.withColumn("cost", _at_depth(F.col("tokens"), F.col("depth")))
    r = r.withColumn("so_far", F.sum("cost").over(w)).withColumn("used", F.sum("cost").over(every)).filter((F.col("used") <= budget) | (F.col("so_far") <= budget) | (F.col("rank") == 1))
    items = r.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "via", "tokens", "depth", "cost"))).alias("items"), F.coalesce(F.sum("cost"), F.lit(0)).alias("used"))
    begin = F.struct((F.lit(budget) - F.col("used")).cast("bigint").alias("room"), F.array().cast("array<int>").alias("depths"))

    def lift(state: Column, x: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), x["depth"]), lambda d: _at_depth(x["tokens"], d) - x["cost"] <= state["room"])
        to = F.coalesce(F.try_element_at(fits, F.lit(1)), x["depth"])
        return F.struct((state["room"] - (_at_depth(x["tokens"], to) - x["cost"])).cast("bigint").alias("room"), F.array_append(state["depths"], to.cast("int")).alias("depths"))

    lifted = items.select(F.explode(F.arrays_zip("items", F.aggregate("items", begin, lift, lambda s: s["depths"]).alias("depths"))).alias("z"))
    x, d = F.col("z.items"), F.col("z.depths")
    return lifted.select(x["id"].alias("id"), x["via"].alias("via"), d.alias("depth"), _at_depth(x["tokens"], d).cast("bigint").alias("cost"))


def ent_pack(spark, sf_dir):
    """The best matches of a query and what they link to, each as deep as 700 tokens allow."""
    rows = stored(E.current(table(spark, sf_dir, "entities")).select("id", "kind", "names", "summary", "topics", "concept", "wiki_links", "evidence"), "rows")
    size = F.length("id") + F.coalesce(F.length("summary"), F.lit(0)) + F.length(F.array_join("names", " ")) + 40 * F.greatest(F.coalesce(F.size("evidence"), F.lit(0)), F.lit(0))
    known = rows.select("id", F.floor(size / 4).alias("tokens"), "wiki_links")
    found = stored(E.search(rows, "marine", 20).join(known, "id"), "found")
    linked = found.select(F.explode("wiki_links").alias("t")).select(F.lower(F.trim("t")).alias("id")).distinct().join(found.select("id"), "id", "left_anti").join(known.select("id", "tokens"), "id")
    both = found.select("id", "tokens", "score", F.lit(0).alias("via")).unionByName(linked.select("id", "tokens", F.lit(0.0).alias("score"), F.lit(1).alias("via")))
    ranked = both.withColumn("rank", F.row_number().over(Window.orderBy("via", F.desc("score"), "id"))).withColumn("start", F.when(F.col("via") == 0, 0).otherwise(2))
    return packed_by_depth(ranked, 700)


QUERIES = {f.__name__: f for f in [vec_half_recall, vec_sign_recall, vec_actions, corpora_fingerprints, run_tasks, run_fuzzy, doc_page_rules, graph_risk, graph_limited, ent_pack]}

_PAIRS = """with u as (select * from embedding_entries where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.corpus_id, a.entry_id, b.entry_id as other, round(list_cosine_similarity(a.embedding, b.embedding) + 1e-9, 6) as exact, round(list_cosine_similarity(a.embedding[:32], b.embedding[:32]) + 1e-9, 6) as short,
 round(list_dot_product(a.embedding, list_transform(b.embedding, lambda x: case when x >= 0 then 1.0::double else -1.0::double end)) + 1e-9, 6) as signs from u a join u b on a.corpus_id = b.corpus_id and a.entry_id <> b.entry_id where a.entry_id % 100 = 0)"""
_RECALL = _PAIRS + """, r as (select *, row_number() over (partition by entry_id order by exact desc, other) as t, row_number() over (partition by entry_id order by {0} desc, other) as p from p)
select *, recall >= 0.98 as passed from (select corpus_id, count(distinct entry_id) as queries, round(avg(case when p <= {1} then 1.0::double else 0 end) + 1e-9, 6) as recall from r where t <= 10 group by 1)"""
_EDGES = _CUR + """, raw as (select id as source, unnest(wiki_links) as t, 'links_to' as kind, 0.5::double as weight from cur union all select id, unnest(list_transform(evidence, lambda x: x.source_id)), 'references', 0.4::double from cur
 union all select id, unnest(person.affiliations), 'depends_on', 0.4::double from cur),
edges as (select distinct source, target, kind, weight from (select source, lower(trim(t)) as target, kind, weight from raw where t is not null) where target <> '' and not starts_with(target, 'https://') and target <> source)
"""
_D = lambda t, d: f"greatest(5, floor({t} * [1.0, 0.40, 0.20, 0.08, 0.03][({d}) + 1]::double))::bigint"

SQL = {
    "vec_half_recall": _RECALL.format("short", 10),
    "vec_sign_recall": _RECALL.format("signs", 100),
    "vec_actions": "select corpus_id, action, count(*) as entries from (select corpus_id, case when row_number() over w = 1 then 'add' when lag(content_hash) over w is not distinct from content_hash then 'same' else 'replace' end as action from embedding_entries window w as (partition by corpus_id, file_id order by ingested_at, entry_id) union all select corpus_id, 'remove' from (select distinct corpus_id, file_id from embedding_entries) e where not exists (select 1 from source_files s where s.corpus_id = e.corpus_id and s.path = e.file_id)) group by 1, 2",
    "corpora_fingerprints": "with last as (select * from (select *, row_number() over (partition by corpus_id, path order by indexed_at desc, hash desc nulls last, tokens desc) as k from source_files) where k = 1) select corpus_id, count(*) as files, sum(('0x' || left(md5(path || '|' || coalesce(hash, '')), 12))::bigint)::varchar as fingerprint from last group by 1",
    "run_tasks": r"select case when regexp_matches(q, 'fix|bug|error|crash|broken|issue') then 'fix' when regexp_matches(q, '\bresearch\b|find|look.*up|what.*about') then 'research' when regexp_matches(q, '\breview\b|pr\b|pull request|diff|changes') then 'review' when regexp_matches(q, 'explain|how does|what is|understand|walk.*through') then 'explain' when regexp_matches(q, 'add|build|create|implement|feature|new') then 'build' when regexp_matches(q, 'document|readme|write.*doc|api.*doc') then 'document' else 'explain' end as task, config, count(*) as runs from (select distinct on (run_id) *, lower(coalesce(query_text, '')) as q from retrieval_runs) group by 1, 2",
    "run_fuzzy": """with r as (select distinct on (run_id) run_id, list_distinct(list_transform(list_filter(coalesce(ground_truth, []), lambda p: p is not null), lambda p: lower(p))) as t, list_distinct(list_transform(list_filter(coalesce(retrieved, []), lambda p: p is not null), lambda p: lower(p))) as g from retrieval_runs where error is null),
a as (select run_id, count(distinct x) as n from (select run_id, unnest(t) as x, g from r) , unnest(g) as y(y) where contains(x, y) or contains(y, x) or regexp_extract(x, '[^/]*$') = regexp_extract(y, '[^/]*$') group by 1),
b as (select run_id, count(distinct y) as n from (select run_id, unnest(g) as y, t from r) , unnest(t) as x(x) where contains(x, y) or contains(y, x) or regexp_extract(x, '[^/]*$') = regexp_extract(y, '[^/]*$') group by 1)
select r.run_id, round(case when len(t) > 0 then coalesce(a.n, 0)::double / len(t) else 0 end + 1e-9, 6) as recall, round(case when len(g) > 0 then coalesce(b.n, 0)::double / len(g) else 0 end + 1e-9, 6) as precision from r left join a using (run_id) left join b using (run_id)""",
    "doc_page_rules": r"""with f as (select doc_id, regexp_extract(text, '^---\s*\n([\s\S]*?)\n---\s*\n', 1) as front from documents), k as (select doc_id, regexp_extract_all(front, '(?m)^([A-Za-z_]\w*):', 1) as keys, trim(regexp_extract(front, '(?m)^kind:[ \t]*([^\r\n]*)', 1)) as kind from f where front <> ''),
m as (select *, list_sort(list_filter(['id', 'kind', 'title', 'slug', 'scope', 'sources', 'confidence', 'updated', 'last_verified_at', 'schema_version'], lambda x: not list_contains(keys, x))) as gone from k)
select kind, case when not list_contains(keys, 'schema_version') then 'schema_version' when len(gone) > 0 then 'missing keys' when kind not in ('concept', 'component', 'decision', 'actor', 'process', 'metric', 'code') then 'kind' when kind = 'decision' and not list_has_all(keys, ['supersedes', 'superseded_by', 'valid_until']) then 'decision keys' else 'valid' end as rule, array_to_string(gone, ',') as missing, count(*) as pages from m group by 1, 2, 3""",
    "graph_risk": _EDGES + f""", c as (select id from cur order by updated_at desc, id limit 10), hubs as (select target as id from edges group by 1 having count(*) > 10), a as (select distinct source as id from edges where target in (select id from c) and source not in (select id from c)),
b as (select distinct source as id from edges where target in (select id from a where id not in (select id from hubs)) and source not in (select id from c) and source not in (select id from a)),
h as (select id, 1 as hops, round(1.0::double / 2, 6) as risk from a union all select id, 2, round(1.0::double / 3, 6) from b),
s as (select id, kind, case when last_verified_at is null then 1 else greatest(0.3::double, round(greatest(0, 1 - greatest(epoch_us(timestamp '{NOW}') - epoch_us(last_verified_at), 0) / 86400000000.0::double / (2 * case kind when 'org' then 180 when 'person' then 90 else 365 end)), 3)) end as fresh from cur)
select id, hops, round(risk * case kind when 'decision' then 1.0::double when 'component' then 0.9::double when 'concept' then 0.8::double when 'code' then 0.7::double else 0.6::double end * fresh + 1e-9, 5) as risk from h join s using (id)""",
    "graph_limited": _EDGES + """, li as (select * from edges where kind = 'links_to'), s as (select target as id, 1.0::double as r from (select target, count(*) as n from li group by 1 order by n desc, target limit 5)),
a as (select target as id, max(round(r * weight * 0.65::double, 9)) as r from s join li on id = source where round(r * weight * 0.65::double, 9) >= 0.05 group by 1), b as (select target as id, max(round(r * weight * 0.65::double, 9)) as r from a join li on id = source where round(r * weight * 0.65::double, 9) >= 0.05 group by 1)
select id, max(r) as relevance from (select * from s union all select * from a union all select * from b) group by 1 order by 2 desc, 1 limit 30""",
    "ent_pack": _CUR.replace("with ", "with recursive ", 1) + f""", sc as (select *, least(round(case when contains(lower(id), 'marine') then 0.5 else 0 end + case when len(list_filter(names, lambda n: contains(lower(n), 'marine'))) > 0 then 0.4 else 0 end + case when contains(lower(summary), 'marine') then 0.15 else 0 end + case when contains(lower(concept.statement), 'marine') then 0.15 else 0 end + 0.05 * coalesce(len(list_filter(topics, lambda t: contains(lower(t), 'marine'))), 0), 6), 1)::double as score,
 floor((length(id) + coalesce(length(summary), 0) + length(array_to_string(names, ' ')) + 40 * coalesce(len(evidence), 0)) / 4.0::double)::bigint as tokens from cur),
f as (select id, tokens, wiki_links, score from sc where score > 0 order by score desc, id limit 20), n as (select distinct lower(trim(t)) as id from (select unnest(wiki_links) as t from f)),
b as (select id, tokens, score, 0 as via from f union all select sc.id, sc.tokens, 0, 1 from n join sc on sc.id = n.id where n.id not in (select id from f)),
o as (select *, row_number() over (order by via, score desc, id) as rank, case when via = 0 then 0 else 2 end as start from b),
d as (select *, {_D('tokens', 'start')} as full_, {_D('tokens', '4')} as least_ from o), e as (select *, sum(full_) over () - coalesce(sum(full_ - least_) over (order by rank rows between 1 following and unbounded following), 0) - 700 as need from d),
g as (select *, case when need <= 0 then start else coalesce((select min(k) from range(start, 5) as t(k) where full_ - {_D('tokens', 'k::int')} >= need), 4) end as depth from e), h as (select *, {_D('tokens', 'depth::int')} as cost from g),
i as (select *, row_number() over (order by rank) as j from (select *, sum(cost) over (order by rank) as so_far, sum(cost) over () as used from h) where used <= 700 or so_far <= 700 or rank = 1),
l as (select 0::bigint as j, null::varchar as id, null::int as via, 0::int as depth, 0::bigint as cost, (700 - (select sum(cost) from i))::bigint as room
  union all select i.j, i.id, i.via, x.to_, {_D('i.tokens', 'x.to_')}, (x.room - ({_D('i.tokens', 'x.to_')} - i.cost))::bigint from (select l.j + 1 as j, l.room, list_min(list_filter(range(0, i.depth + 1), lambda k: greatest(5, floor(i.tokens * [1.0, 0.40, 0.20, 0.08, 0.03][k + 1]::double)) - i.cost <= l.room or k = i.depth))::int as to_ from l join i on i.j = l.j + 1) x join i on i.j = x.j)
select id, via, depth, cost from l where j > 0""",
}
