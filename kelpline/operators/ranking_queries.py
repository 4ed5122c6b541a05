"""Queries over rankings and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import vectors as V
from kelpline.operators import files as X
from kelpline.operators import ranking as K
from kelpline.operators import retrieval as R
from kelpline.session import stored
from kelpline.tables import table

QUERY = "vessel signal ranking schema"


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usable_entries(table(spark, sf_dir, "embedding_entries"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = K.query_kind(F.col("query_text"))
    return R.distinct_runs(table(spark, sf_dir, "retrieval_runs")).filter("error is null").withColumn("kind", kind).withColumn("weight", K.kind_weight(F.col("kind")))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, vectors = _runs(spark, sf_dir), stored(K.file_vectors(_usable(spark, sf_dir)), "file_vectors")
    return K.with_relevance(runs, K.asked_vectors(runs, ["run_id", "corpus_id"], "ground_truth", vectors), vectors)


def run_query_kinds(spark, sf_dir):
    """Runs by the kind of their query and the weight of relevance that follows."""
    return _runs(spark, sf_dir).groupBy("kind", "weight").agg(F.count(F.lit(1)).alias("runs"))


def run_search(spark, sf_dir):
    """Of each task, the ten entries of its corpus nearest to the mean vector of its true files."""
    runs, usable = _runs(spark, sf_dir), _usable(spark, sf_dir)
    asked = K.asked_vectors(runs, ["task_id", "corpus_id"], "ground_truth", K.file_vectors(usable))
    entries = stored(usable.select("corpus_id", "entry_id", V.unit(F.col("embedding")).alias("u")), "entries")
    return K.search(entries, asked, "task_id", "corpus_id", 10).select("task_id", "corpus_id", "entry_id", "similarity", "place")


def run_search_allowed(spark, sf_dir):
    """The same among the entries of files that are ground truth or framework, from a cosine of .3 on."""
    runs, usable = _runs(spark, sf_dir), _usable(spark, sf_dir)
    asked = K.asked_vectors(runs, ["task_id", "corpus_id"], "ground_truth", K.file_vectors(usable))
    allowed = X.latest(table(spark, sf_dir, "source_files").select("corpus_id", "path", "knowledge_type", "indexed_at", "hash", "tokens")).filter("knowledge_type in ('ground_truth', 'framework')").select("corpus_id", F.col("path").alias("file_id"))
    entries = stored(usable.join(allowed, ["corpus_id", "file_id"], "left_semi").select("corpus_id", "entry_id", V.unit(F.col("embedding")).alias("u")), "entries")
    return K.search(entries, asked, "task_id", "corpus_id", 5, 0.3).select("task_id", "corpus_id", "entry_id", "similarity", "place")


def run_mmr(spark, sf_dir):
    """Each run's list, chosen again for relevance and diversity."""
    return K.diversified(_members(spark, sf_dir))


def run_diversity(spark, sf_dir):
    return K.diversity(_members(spark, sf_dir), "run_id")


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.keyword_scored(X.latest(table(spark, sf_dir, "source_files").select("corpus_id", "path", "headings", "tokens", "indexed_at", "hash")), QUERY).filter("relevance > 0")


def hybrid_find(spark, sf_dir):
    """Of each corpus, the fifteen best files by keywords and by likeness to the corpus' mean vector."""
    usable = _usable(spark, sf_dir)
    vectors = K.file_vectors(usable).join(R.centroids(usable, "corpus_id"), "corpus_id")
    semantic = vectors.select("corpus_id", F.col("file_id").alias("path"), K.off_half(V.cosine(F.col("v"), F.col("centroid"))).alias("similarity"))
    return K.fused_ranks(_keyword(spark, sf_dir).select("corpus_id", "path", "relevance"), semantic, "corpus_id", "path", 15)


def find_across(spark, sf_dir):
    """The five best files by keywords of every corpus in turns, within 20 000 tokens together."""
    found = _keyword(spark, sf_dir).select("corpus_id", "path", "relevance", "tokens")
    return K.merged_with_quota(found, "corpus_id", 20_000, 5).select("corpus_id", "path", "relevance", "tokens", "turn", "used")


def find_confidence(spark, sf_dir):
    """Whether a corpus' ten best files by keywords are too weak, on the mean, to answer."""
    from pyspark.sql import Window

    w = Window.partitionBy("corpus_id").orderBy(F.desc("relevance"), "path")
    best = _keyword(spark, sf_dir).select("corpus_id", "path", "relevance").withColumn("r", F.row_number().over(w)).filter("r <= 10")
    mean = best.groupBy("corpus_id").agg(F.avg("relevance").alias("m"), F.count(F.lit(1)).alias("files"))
    known = table(spark, sf_dir, "corpora").select("corpus_id").distinct()
    return known.join(mean, "corpus_id", "left").select("corpus_id", F.coalesce("files", F.lit(0)).alias("files"), K.off_half(F.coalesce("m", F.lit(0.0))).alias("mean"), (F.coalesce("m", F.lit(0.0)) < 0.25).alias("is_low"))


def run_pairs(spark, sf_dir):
    """Tasks that two configurations ran: mean recall of each and the difference."""
    m = R.metrics(_runs(spark, sf_dir)).filter("n_truth > 0").groupBy("task_id", "config").agg(F.avg("recall").alias("recall"))
    a, b = (m.select("task_id", F.col("config").alias(f"config_{x}"), F.col("recall").alias(f"recall_{x}")) for x in "ab")
    d = a.join(b, "task_id").filter("config_a < config_b")
    return d.select("task_id", "config_a", "config_b", K.off_half(F.col("recall_a")).alias("recall_a"), K.off_half(F.col("recall_b")).alias("recall_b"), K.off_half(F.col("recall_b") - F.col("recall_a")).alias("difference"))


def run_reachable(spark, sf_dir):
    """Mean recall of each configuration over its own tasks and over those at least two configurations ran without error."""
    m = R.metrics(_runs(spark, sf_dir)).filter("n_truth > 0").select("task_id", "config", "recall")
    shared = m.groupBy("task_id").agg(F.countDistinct("config").alias("n")).filter("n >= 2").select("task_id", F.lit(True).alias("both"))
    d = m.join(shared, "task_id", "left")
    return d.groupBy("config").agg(F.countDistinct("task_id").alias("tasks"), K.off_half(F.avg("recall")).alias("recall"), F.countDistinct(F.when(F.col("both"), F.col("task_id"))).alias("shared_tasks"), K.off_half(F.avg(F.when(F.col("both"), F.col("recall")))).alias("shared_recall"))


def run_packed(spark, sf_dir):
    """Each run's files packed into its budget; relevance falls with the place."""
    files = X.latest(table(spark, sf_dir, "source_files").select("corpus_id", "path", "tokens", "indexed_at", "hash")).select("corpus_id", "path", F.col("tokens").cast("bigint").alias("tokens"))
    listed = R.distinct_runs(table(spark, sf_dir, "retrieval_runs")).filter("budget is not null").select("run_id", "corpus_id", F.col("budget").cast("bigint").alias("budget"), F.posexplode("retrieved").alias("p", "path")).filter("path is not null")
    listed = listed.groupBy("run_id", "corpus_id", "budget", "path").agg(F.min("p").alias("p")).join(files, ["corpus_id", "path"])
    return K.packed(listed.select("run_id", "budget", "path", (1.0 / (1 + F.col("p") / 4.0)).alias("relevance"), "tokens"))


QUERIES = {f.__name__: f for f in [run_query_kinds, run_search, run_search_allowed, run_mmr, run_diversity, hybrid_find, find_across, find_confidence, run_pairs, run_reachable, run_packed]}

_USABLE = """u as (select * from embedding_entries where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
f as (select corpus_id, file_id, arg_min(embedding, entry_id) as v from u group by 1, 2)"""
_RUNS = r"""r as (select *, case kind when 'analytical' then 0.5::double when 'factual' then 0.9::double else 0.7::double end as weight from (
  select distinct on (run_id) *, case when regexp_matches(coalesce(query_text, ''), '\b(compare|vs|versus|evaluate|pros and cons|advantages|disadvantages|should we|tradeoffs?|better|worse|choose|decide|recommend)\b', 'i') then 'analytical'
   when length(coalesce(query_text, '')) < 50 or regexp_matches(coalesce(query_text, ''), '\b(what is|how does|who is|when did|where is|define|definition|version|spec|api|format|syntax|command)\b', 'i') then 'factual' else 'exploratory' end as kind
  from retrieval_runs) where error is null)"""
_MEAN = "list_transform(range(1, 65), lambda i: list_sum(list_transform(vs, lambda v: v[i])) / len(vs))"
_ASKED = lambda key: f"""t as (select distinct {key}, corpus_id, unnest(ground_truth) as file_id from r),
q as (select {key}, corpus_id, {_MEAN} as q from (select {key}, corpus_id, list(v order by file_id) as vs from t join f using (corpus_id, file_id) group by 1, 2))"""  # noqa: E731
_LISTED = """l as (select run_id, corpus_id, top_k, weight, file_id, min(i) as i from (select run_id, corpus_id, top_k, weight, generate_subscripts(retrieved, 1) as i, unnest(retrieved) as file_id from r) where file_id is not null group by 1, 2, 3, 4, 5),
m as (select l.*, v, round(list_cosine_similarity(v, q) + 1e-9, 6) as relevance from l join f using (corpus_id, file_id) join q using (run_id, corpus_id))"""
_LAST = "last as (select * exclude (_r) from (select *, row_number() over (partition by corpus_id, path order by indexed_at desc, hash desc nulls last, tokens desc) as _r from source_files) where _r = 1)"

#: The relevance of each file for QUERY, spelled out: each word's points by place, whole word before stem before part.
KEYWORD = _LAST + r""",
w(t, s) as (values ('vessel', 'vessel'), ('signal', 'sign'), ('ranking', 'rank'), ('schema', 'schema')),
p as (select corpus_id, path, tokens, lower(path) as lp, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) as dir, regexp_extract(path, '([^/]*?)([.][^./]*)?$', 1) as name, lower(coalesce(array_to_string(list_transform(headings, lambda h: h.title), ' '), '')) as heads from last),
stems as (select word, coalesce(min(case when length(word) >= length(x) + 4 and ends_with(word, x) then left(word, length(word) - length(x)) end order by o) filter (length(word) >= length(x) + 4 and ends_with(word, x)), word) as stem from
  (select distinct unnest(list_concat(regexp_split_to_array(lp, '[-/_.]'), regexp_split_to_array(heads, '\s+'), regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\s_-]+'))) as word from p) cross join
  (select unnest(['alization','ization','isation','ation','ising','izing','ment','ness','tion','sion','able','ible','ing','ous','ive','ful','less','ial','al','eur','ier','ère','ion','er','ed','ly','es','s']) as x, generate_subscripts(['alization','ization','isation','ation','ising','izing','ment','ness','tion','sion','able','ible','ing','ous','ive','ful','less','ial','al','eur','ier','ère','ion','er','ed','ly','es','s'], 1) as o) group by word),
pw as (select corpus_id, path, unnest(regexp_split_to_array(lp, '[-/_.]')) as word from p), pws as (select corpus_id, path, word, case when length(word) >= 3 then stem end as stem from pw join stems using (word)),
nw as (select corpus_id, path, unnest(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\s_-]+')) as word from p), nws as (select corpus_id, path, word, case when length(word) >= 3 then stem end as stem from nw join stems using (word)),
hw as (select corpus_id, path, generate_subscripts(regexp_split_to_array(heads, '\s+'), 1) as i, unnest(regexp_split_to_array(heads, '\s+')) as word from p),
hs as (select corpus_id, path, string_agg(stem, ' ' order by i) filter (length(word) >= 3) as head_stems from hw join stems using (word) group by 1, 2),
pts as (select p.corpus_id, p.path, p.tokens, w.t,
  case when exists (select 1 from pws x where x.corpus_id = p.corpus_id and x.path = p.path and x.word = w.t) then 0.3 when exists (select 1 from pws x where x.corpus_id = p.corpus_id and x.path = p.path and x.stem = w.s) then 0.25 when contains(p.lp, w.t) then 0.15 else 0 end
  + case when contains(p.heads, w.t) then 0.2 when contains(coalesce(h.head_stems, ''), w.s) then 0.15 else 0 end
  + case when exists (select 1 from nws x where x.corpus_id = p.corpus_id and x.path = p.path and x.word = w.t) then 0.2 when exists (select 1 from nws x where x.corpus_id = p.corpus_id and x.path = p.path and x.stem = w.s) then 0.15 when contains(p.name, w.t) then 0.1 else 0 end
  + case when contains(p.dir, w.t) then 0.1 else 0 end as points
  from p cross join w left join hs h on h.corpus_id = p.corpus_id and h.path = p.path),
k as (select corpus_id, path, any_value(tokens) as tokens, round(least(1.0::double, sum(points)::double + case when count(*) filter (points > 0) >= 2 then count(*) filter (points > 0) * 0.3::double / 4 else 0 end), 6) as relevance from pts group by 1, 2 having sum(points) > 0)"""

SQL = {
    "run_query_kinds": f"with {_RUNS} select kind, weight, count(*) as runs from r group by 1, 2",
    "run_search": f"""with {_USABLE}, {_RUNS}, {_ASKED('task_id')}, s as (select task_id, corpus_id, entry_id, round(list_cosine_similarity(embedding, q) + 1e-9, 6) as similarity from u join q using (corpus_id))
select * from (select *, row_number() over (partition by task_id, corpus_id order by similarity desc, entry_id)::int as place from s where similarity >= 0.15) where place <= 10""",
    "run_search_allowed": f"""with {_USABLE}, {_RUNS}, {_ASKED('task_id')}, {_LAST}, s as (select task_id, corpus_id, entry_id, round(list_cosine_similarity(embedding, q) + 1e-9, 6) as similarity from u join q using (corpus_id) where (corpus_id, file_id) in (select (corpus_id, path) from last where knowledge_type in ('ground_truth', 'framework')))
select * from (select *, row_number() over (partition by task_id, corpus_id order by similarity desc, entry_id)::int as place from s where similarity >= 0.3) where place <= 5""",
    "run_mmr": f"""with recursive {_USABLE}, {_RUNS}, {_ASKED('run_id')}, {_LISTED},
n as (select *, row_number() over (partition by run_id order by i) as j from m),
c as (select a.run_id, a.j, a.file_id, a.top_k, a.weight, a.relevance, list(round(list_cosine_similarity(a.v, b.v) + 1e-9, 6) order by b.j) as near from n a join n b using (run_id) group by all),
g as (select run_id, 0 as place, []::bigint[] as chosen, null::varchar as file_id, null::double as score from (select distinct run_id from c)
  union all
  select run_id, place + 1, list_append(chosen, b.j), b.file_id, b.score from (
    select g.run_id, g.place, g.chosen, arg_max(struct_pack(j := c.j, file_id := c.file_id, score := c.weight * c.relevance - (1 - c.weight) * coalesce(list_max(list_transform(g.chosen, lambda x: c.near[x])), 0)),
      struct_pack(s := c.weight * c.relevance - (1 - c.weight) * coalesce(list_max(list_transform(g.chosen, lambda x: c.near[x])), 0), e := -c.j)) as b
    from g join c using (run_id) where not list_contains(g.chosen, c.j) and g.place < c.top_k group by 1, 2, 3))
select run_id, place::int as place, file_id, round(score + 1e-9, 6) as score from g where place > 0""",
    "run_diversity": f"""with {_USABLE}, {_RUNS}, {_ASKED('run_id')}, {_LISTED}
select run_id, sqrt(count(*))::bigint as files, round(coalesce(1 - avg(list_cosine_similarity(a.v, b.v)) filter (a.i <> b.i), 1) + 1e-9, 5) as diversity from m a join m b using (run_id) group by 1""",
    "hybrid_find": f"""with {_USABLE}, {KEYWORD}, e as (select corpus_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from u), cen as (select corpus_id, list(a order by i) as c from (select corpus_id, i, avg(x) as a from e group by 1, 2) group by 1),
s as (select corpus_id, file_id as path, round(list_cosine_similarity(v, c) + 1e-9, 6) as similarity from f join cen using (corpus_id)),
kr as (select *, row_number() over (partition by corpus_id order by relevance desc, path) as rk from k where relevance >= 0.1), sr as (select *, row_number() over (partition by corpus_id order by similarity desc, path) as rs from s where similarity >= 0.15),
b as (select corpus_id, path, round(greatest(coalesce(relevance, 0), coalesce(similarity, 0)), 4) as confidence, round(coalesce(1::double / (60 + rk), 0) + coalesce(1::double / (60 + rs), 0), 9) as bonus, case when rs is null then 'keyword' when rk is null then 'semantic' else 'both' end as reason from kr full join sr using (corpus_id, path))
select * exclude (bonus) from (select *, row_number() over (partition by corpus_id order by confidence desc, bonus desc, path)::int as place from b) where place <= 15""",
    "find_across": f"""with {KEYWORD}, o as (select * from (select *, row_number() over (partition by corpus_id order by relevance desc, path)::int as turn from k) where turn <= 5)
select * from (select corpus_id, path, relevance, tokens, turn, sum(tokens) over (order by turn, corpus_id)::bigint as used from o) where used <= 20000""",
    "find_confidence": f"""with {KEYWORD}, b as (select corpus_id, avg(relevance) as m, count(*) as files from (select *, row_number() over (partition by corpus_id order by relevance desc, path) as r from k) where r <= 10 group by 1)
select corpus_id, coalesce(files, 0) as files, round(coalesce(m, 0) + 1e-9, 6) as mean, coalesce(m, 0) < 0.25 as is_low from (select distinct corpus_id from corpora) left join b using (corpus_id)""",
    "run_pairs": f"""with {_RUNS}, x as (select task_id, config, list_distinct(list_transform(list_filter(ground_truth, lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', ''))) as truth, list_transform(list_filter(coalesce(retrieved, []), lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', '')) as got from r),
m as (select task_id, config, avg(len(list_intersect(got, truth))::double / len(truth)) as recall from x where len(truth) > 0 group by 1, 2)
select a.task_id, a.config as config_a, b.config as config_b, round(a.recall + 1e-9, 6) as recall_a, round(b.recall + 1e-9, 6) as recall_b, round(b.recall - a.recall + 1e-9, 6) as difference from m a join m b on a.task_id = b.task_id and a.config < b.config""",
    "run_reachable": f"""with {_RUNS}, x as (select task_id, config, list_distinct(list_transform(list_filter(ground_truth, lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', ''))) as truth, list_transform(list_filter(coalesce(retrieved, []), lambda p: p is not null), lambda p: regexp_replace(p, '^[^/:]*:', '')) as got from r),
m as (select task_id, config, len(list_intersect(got, truth))::double / len(truth) as recall from x where len(truth) > 0), s as (select task_id from m group by 1 having count(distinct config) >= 2)
select config, count(distinct m.task_id) as tasks, round(avg(recall) + 1e-9, 6) as recall, count(distinct s.task_id) as shared_tasks, round(avg(recall) filter (s.task_id is not null) + 1e-9, 6) as shared_recall from m left join s using (task_id) group by 1""",
    "run_packed": f"""with recursive {_LAST}, r as (select distinct on (run_id) * from retrieval_runs), e as (select run_id, corpus_id, budget, unnest(retrieved) as path, generate_subscripts(retrieved, 1) as i from r where budget is not null),
l as (select run_id, budget, path, 1.0::double / (1 + (min(i) - 1) / 4.0::double) as rel, any_value(last.tokens) as tokens from e join last using (corpus_id, path) where path is not null group by 1, 2, 3),
o as (select *, greatest(5, tokens)::bigint as w, greatest(5, floor(tokens * 0.03::double))::bigint as p, rel >= 0.4 as f, row_number() over (partition by run_id order by rel desc, tokens, path) as j from l),
d as (select *, f and total - coalesce(later, 0) > budget as cut from (select *, sum(case when f then w else p end) over (partition by run_id) as total, sum(case when f then w - p else 0 end) over (partition by run_id order by j rows between 1 following and unbounded following) as later from o)),
h as (select * from (select *, sum(case when f and not cut then w else p end) over (partition by run_id order by j) as so_far, sum(case when f and not cut then w else p end) over (partition by run_id) as used from d) where used <= budget or so_far <= budget),
z as (select run_id, j, path, budget, f and not cut as kept, w, p, row_number() over (partition by run_id order by j) as n, sum(case when f and not cut then w else p end) over (partition by run_id) as begun from h),
g as (select run_id, 0::bigint as n, null::varchar as path, max(begun)::bigint as used, null::int as depth, null::bigint as cost from z group by 1
  union all
  select z.run_id, z.n, z.path, (case when up then g.used + z.w - z.p else g.used end)::bigint, case when z.kept or up then 0 else 4 end, (case when z.kept or up then z.w else z.p end)::bigint
  from (select z.*, g.used as g_used, not z.kept and z.begun < 0.92::double * z.budget and g.used < 0.95::double * z.budget and g.used + z.w - z.p <= z.budget as up from g join z on z.run_id = g.run_id and z.n = g.n + 1) z join g on g.run_id = z.run_id and g.n = z.n - 1)
select run_id, path, depth, cost from g where n > 0""",
}
