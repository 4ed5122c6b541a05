"""Further queries over entities and corpora: filters, budgets, conflicting values, ages by nearest rank, the whole audit; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.operators import entities as E
from kelpline.session import stored
from kelpline.tables import table

NOW = "2026-11-01 00:00:00"
ID = "^[a-z][a-z0-9-]{0,63}:[a-z0-9][a-z0-9-]{0,127}$"  #: Fixed value: the form of an id.


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.current(table(spark, sf_dir, "entities"))


def ent_filtered(spark, sf_dir):
    """Organisations and concepts with a topic of the three that most entities have."""
    rows = stored(_current(spark, sf_dir).select("id", "kind", "topics"), "topics")
    top = rows.select(F.explode(F.array_distinct("topics")).alias("t")).filter("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(3)
    wanted = [r["t"] for r in top.collect()]  # three rows
    hits = F.array_sort(F.array_intersect("topics", F.array(*map(F.lit, wanted)).cast("array<string>")))
    return rows.filter(F.col("kind").isin("org", "concept")).withColumn("hits", hits).filter(F.size("hits") > 0).select("id", "kind", F.array_join("hits", ",").alias("hits"))


def ent_link_counts(spark, sf_dir):
    """How often an entity is linked, repeats and all, and by how many others."""
    links = _current(spark, sf_dir).select("id", F.explode("wiki_links").alias("t")).filter("t is not null").select("id", F.lower(F.trim("t")).alias("target")).filter("target <> '' and not startswith(target, 'https://')")
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("id").alias("entities")).filter("links > 1")


def ent_conflicts(spark, sf_dir):
    """The values of each contradicted claim, with their sources."""
    measured = E.claims(_current(spark, sf_dir))
    keys = E.contradictions(measured).select(*E.CLAIM_KEY)
    said = F.concat_ws("=", F.coalesce("source", F.lit("?")), F.coalesce("value", F.lit("null")))
    return measured.join(keys, E.CLAIM_KEY, "left_semi").groupBy(*E.CLAIM_KEY).agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("said"))


def ent_ages(spark, sf_dir):
    """Days since the last update of each kind: the nearest ranks at 50, 90 and 99 of 100, and the oldest. Counted by day, so that no kind is sorted as a whole."""
    days = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.coalesce("updated_at", "created_at").cast("timestamp"))) / 86_400_000_000)
    counts = _current(spark, sf_dir).withColumn("days", days).filter("days is not null").groupBy("kind", "days").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind")  # one row per day
    placed = counts.withColumn("until", F.sum("n").over(w.orderBy("days"))).withColumn("all", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("until") > F.least(F.floor(F.lit(p) * F.col("all")), F.col("all") - 1), F.col("days")))
    return placed.groupBy("kind").agg(at(0.5).alias("p50_days"), at(0.9).alias("p90_days"), at(0.99).alias("p99_days"), F.max("days").alias("oldest_days"))


def ent_fresh_enough(spark, sf_dir):
    """Entities with a freshness of at least a half, and those never verified, which pass."""
    rows = E.freshness(_current(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return rows.filter("score is null or score >= 0.5").select("id", "kind", "score")


def ent_budget(spark, sf_dir):
    """The best matches of a query within 4 000 characters, at least one, and their linked entities in what is left."""
    rows = stored(_current(spark, sf_dir).select("id", "kind", "names", "summary", "topics", "concept", "wiki_links"), "rows")
    found = stored(E.search(rows, "marine", 20).join(rows.select("id", "summary", "wiki_links"), "id"), "found")
    cost = F.length("id") + F.coalesce(F.length("summary"), F.lit(0)) + 2
    w = Window.orderBy("via", F.desc("score"), "id")  # at most 20 matches and what they link to
    linked = found.select(F.explode("wiki_links").alias("t")).select(F.lower(F.trim("t")).alias("id")).distinct().join(found.select("id"), "id", "left_anti").join(rows.select("id", "summary"), "id")
    both = found.select("id", "summary", "score", F.lit(0).alias("via")).unionByName(linked.select("id", "summary", F.lit(0.0).alias("score"), F.lit(1).alias("via")))
    packed = both.withColumn("used", 30 + F.sum(cost).over(w)).withColumn("at", F.row_number().over(w))
    return packed.filter("used <= 4000 or at = 1").select("id", "via", F.col("used").cast("bigint").alias("used"))


def ent_invalid(spark, sf_dir):
    """Entities that break the form of an id, lack a name, have too long a summary or an unknown stance."""
    rows = _current(spark, sf_dir)
    stances = F.coalesce(F.col("evidence.stance"), F.array().cast("array<string>"))
    rules = {
        "id": ~F.col("id").rlike(ID),
        "names": F.coalesce(F.size(F.filter("names", lambda n: F.trim(n) != "")), F.lit(0)) < 1,
        "summary": F.coalesce(F.length("summary") > 200, F.lit(False)),
        "stance": F.exists(stances, lambda s: s.isNotNull() & ~s.isin("supports", "contradicts", "mentions", "qualifies", "context")),
        "times": F.coalesce(F.col("updated_at") < F.col("created_at"), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("entities"), F.min("id").alias("first_id"))


def ent_audit(spark, sf_dir):
    """All findings of the audit in one table: rule and subject, counted by rule."""
    rows = stored(_current(spark, sf_dir), "current")
    now = F.lit(NOW).cast("timestamp")
    one = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    found = [
        one(E.contradictions(E.claims(rows)), "contradiction", F.concat_ws("|", *E.CLAIM_KEY)),
        one(E.dead_links(rows, rows), "dead link", F.concat_ws("|", "source", "target")),
        one(E.orphans(rows), "orphan", F.col("id")),
        one(E.merge_candidates(rows), "merge", F.concat_ws("|", "kind", "name")),
        one(E.split_candidates(rows), "split", F.col("id")),
        one(E.stale_assertions(rows), "stale assertion", F.concat_ws("|", "id", "assertion_id")),
        one(E.freshness(rows, now).filter("status = 'stale'"), "stale", F.col("id")),
        one(E.freshness(rows, now).filter("last_verified_at is null"), "never verified", F.col("id")),
        one(E.merge_slugs(rows), "merge slug", F.concat_ws("|", "kind", "name")),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("subject").alias("subjects"), F.min("subject").alias("first_subject"))


def ent_hashes(spark, sf_dir):
    """Entities whose last two rows differ in what they say, by a hash of names, summary, topics and links."""
    text = F.concat_ws("\n", F.array_join("names", "|"), F.coalesce("summary", F.lit("")), F.array_join("topics", "|"), F.array_join("wiki_links", "|"))
    rows = table(spark, sf_dir, "entities").filter("id is not null").select("id", "updated_at", "row_id", F.substring(F.md5(text), 1, 12).alias("hash"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("hash").alias("contents"), F.max_by("hash", F.struct("updated_at", "row_id")).alias("last_hash")).filter("contents > 1")


def corpora_meta(spark, sf_dir):
    """Of each corpus: its row, files, tokens, entries, runs, and what is missing."""
    files = table(spark, sf_dir, "source_files").groupBy("corpus_id").agg(F.countDistinct("path").alias("files"))
    entries = table(spark, sf_dir, "embedding_entries").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("model").alias("models"))
    runs = table(spark, sf_dir, "retrieval_runs").groupBy("corpus_id").agg(F.countDistinct("run_id").alias("runs"))
    known = table(spark, sf_dir, "corpora").select("corpus_id", "lifecycle_state", "model")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(files, "corpus_id", "left").join(entries, "corpus_id", "left").join(runs, "corpus_id", "left").select("corpus_id", "lifecycle_state", n("files"), n("entries"), n("models"), n("runs"), (F.col("entries").isNull() | F.col("files").isNull()).alias("incomplete"))


QUERIES = {f.__name__: f for f in [ent_filtered, ent_link_counts, ent_conflicts, ent_ages, ent_fresh_enough, ent_budget, ent_invalid, ent_audit, ent_hashes, corpora_meta]}

_NOW = f"timestamp '{NOW}'"
_CUR = "cur as (select * exclude (_r) from (select *, row_number() over (partition by id order by updated_at desc nulls last, row_id desc) as _r from entities where id is not null) where _r = 1)"
_LINKS = "links as (select distinct id as source, lower(trim(t)) as target from (select id, unnest(wiki_links) as t from cur) where t is not null and trim(t) <> '' and not starts_with(lower(trim(t)), 'https://'))"
_CLAIMS = """c0 as (select id, unnest(claims) as c from cur), c1 as (select id, c.metric as metric, c.role as role, c.as_of as as_of, unnest(c.measurements) as m from c0),
claims as (select id, lower(trim(coalesce(metric, 'n/a'))) as metric, lower(trim(coalesce(role, 'n/a'))) as role, case lower(trim(coalesce(m.cp_type, 'n/a'))) when 'counterparty' then 'cp' else lower(trim(coalesce(m.cp_type, 'n/a'))) end as cp_type, lower(trim(coalesce(m.tenor, 'n/a'))) as tenor,
 case lower(trim(coalesce(m.status, 'n/a'))) when 'est' then 'estimated' when 'act' then 'actual' else lower(trim(coalesce(m.status, 'n/a'))) end as status, lower(trim(coalesce(as_of, 'n/a'))) as as_of, m.source as source, m.value as value from c1),
bad as (select id, metric, role, cp_type, tenor, status, as_of from claims group by all having count(distinct coalesce(round(try_cast(value as double), 9)::varchar, 's:' || value, 'null')) > 1)"""
_FRESH = f"fresh as (select *, case when last_verified_at is not null then round(greatest(0, 1 - greatest(epoch_us({_NOW}) - epoch_us(last_verified_at), 0) / 86400000000.0::double / (2 * case kind when 'org' then 180 when 'person' then 90 else 365 end)), 3) end as score from cur)"

SQL = {
    "ent_filtered": f"with {_CUR}, t as (select distinct id, unnest(topics) as t from cur), top as (select t from t where t is not null group by t order by count(*) desc, t limit 3) select id, kind, string_agg(t, ',' order by t) as hits from (select id, kind from cur where kind in ('org', 'concept')) join t using (id) where t in (select t from top) group by 1, 2",
    "ent_link_counts": f"with {_CUR} select lower(trim(t)) as target, count(*) as links, count(distinct id) as entities from (select id, unnest(wiki_links) as t from cur) where t is not null and trim(t) <> '' and not starts_with(lower(trim(t)), 'https://') group by 1 having count(*) > 1",
    "ent_conflicts": f"with {_CUR}, {_CLAIMS} select id, metric, role, cp_type, tenor, status, as_of, string_agg(coalesce(source, '?') || '=' || coalesce(value, 'null'), '; ' order by coalesce(source, '?') || '=' || coalesce(value, 'null')) as said from claims join bad using (id, metric, role, cp_type, tenor, status, as_of) group by all",
    "ent_ages": f"with {_CUR}, a as (select kind, list(d order by d) as l from (select kind, floor((epoch_us({_NOW}) - epoch_us(coalesce(updated_at, created_at))) / 86400000000.0::double)::bigint as d from cur where coalesce(updated_at, created_at) is not null) group by 1) select kind, l[least(floor(0.5::double * len(l))::int, len(l) - 1) + 1] as p50_days, l[least(floor(0.9::double * len(l))::int, len(l) - 1) + 1] as p90_days, l[least(floor(0.99::double * len(l))::int, len(l) - 1) + 1] as p99_days, l[len(l)] as oldest_days from a",
    "ent_fresh_enough": f"with {_CUR}, {_FRESH} select id, kind, score from fresh where score is null or score >= 0.5",
    "ent_budget": f"""with {_CUR}, sc as (select *, least(round(case when contains(lower(id), 'marine') then 0.5 else 0 end + case when len(list_filter(names, lambda n: contains(lower(n), 'marine'))) > 0 then 0.4 else 0 end + case when contains(lower(summary), 'marine') then 0.15 else 0 end + case when contains(lower(concept.statement), 'marine') then 0.15 else 0 end + 0.05 * coalesce(len(list_filter(topics, lambda t: contains(lower(t), 'marine'))), 0), 6), 1)::double as score from cur),
f as (select id, summary, wiki_links, score from sc where score > 0 order by score desc, id limit 20), n as (select distinct lower(trim(t)) as id from (select unnest(wiki_links) as t from f)),
b as (select id, summary, score, 0 as via from f union all select cur.id, cur.summary, 0, 1 from n join cur on cur.id = n.id where n.id not in (select id from f))
select id, via, used::bigint as used from (select id, via, 30 + sum(length(id) + coalesce(length(summary), 0) + 2) over (order by via, score desc, id) as used, row_number() over (order by via, score desc, id) as a from b) where used <= 4000 or a = 1""",
    "ent_invalid": f"""with {_CUR}, r as (select id, unnest(list_filter([case when not regexp_matches(id, '^[a-z][a-z0-9-]{{0,63}}:[a-z0-9][a-z0-9-]{{0,127}}$') then 'id' end, case when coalesce(len(list_filter(names, lambda n: trim(n) <> '')), 0) < 1 then 'names' end, case when length(summary) > 200 then 'summary' end,
 case when coalesce(len(list_filter(evidence, lambda e: e.stance is not null and e.stance not in ('supports', 'contradicts', 'mentions', 'qualifies', 'context'))), 0) > 0 then 'stance' end, case when updated_at < created_at then 'times' end], lambda x: x is not null)) as rule from cur) select rule, count(*) as entities, min(id) as first_id from r group by 1""",
    "ent_audit": f"""with {_CUR}, {_LINKS}, {_CLAIMS}, {_FRESH},
every as (select 'contradiction' as rule, concat_ws('|', id, metric, role, cp_type, tenor, status, as_of) as subject from bad
 union all select 'dead link', source || '|' || target from links where target not in (select lower(id) from cur)
 union all select 'orphan', id from cur where coalesce(len(claims), 0) = 0 and coalesce(len(evidence), 0) = 0 and coalesce(trim(concept.statement), '') = '' and lower(id) not in (select target from links)
 union all select 'merge', kind || '|' || n from (select kind, id, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') as n from (select kind, id, unnest(names) as n from cur)) where n <> '' group by kind, n having count(distinct id) > 1
 union all select 'split', id from cur where coalesce(len(list_distinct(list_filter(list_transform(claims, lambda c: c.metric), lambda m: m is not null))), 0) > 1 or coalesce(len(list_distinct(list_filter(topics, lambda t: t is not null))), 0) > 2
 union all select 'stale assertion', id || '|' || a.assertion_id from (select id, identity_assertions, unnest(identity_assertions) as a from cur) where a.status = 'superseded' and not coalesce(list_contains(list_transform(identity_assertions, lambda x: x.assertion_id), a.superseded_by), false)
 union all select 'stale', id from fresh where score < 0.3
 union all select 'never verified', id from cur where last_verified_at is null
 union all select 'merge slug', kind || '|' || n from (select kind, id, regexp_replace(regexp_replace(split_part(lower(id), ':', 2), '-[a-z0-9]{{5}}$', ''), '[^a-z0-9]', '', 'g') as n from cur) where n <> '' group by kind, n having count(distinct id) > 1)
select rule, count(*) as findings, count(distinct subject) as subjects, min(subject) as first_subject from every group by 1""",
    "ent_hashes": "with h as (select id, updated_at, row_id, left(md5(concat_ws(chr(10), coalesce(array_to_string(names, '|'), ''), coalesce(summary, ''), coalesce(array_to_string(topics, '|'), ''), coalesce(array_to_string(wiki_links, '|'), ''))), 12) as hash from entities where id is not null) select id, count(*) as rows, count(distinct hash) as contents, arg_max(hash, struct_pack(u := updated_at, r := row_id)) as last_hash from h group by 1 having count(distinct hash) > 1",
    "corpora_meta": "select c.corpus_id, lifecycle_state, coalesce(files, 0) as files, coalesce(entries, 0) as entries, coalesce(models, 0) as models, coalesce(runs, 0) as runs, entries is null or files is null as incomplete from corpora c left join (select corpus_id, count(distinct path) as files from source_files group by 1) using (corpus_id) left join (select corpus_id, count(*) as entries, count(distinct model) as models from embedding_entries group by 1) using (corpus_id) left join (select corpus_id, count(distinct run_id) as runs from retrieval_runs group by 1) using (corpus_id)",
}
