"""Queries over entities and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import entities as E
from kelpline.tables import table

NOW = "2026-07-01 00:00:00"


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.current(table(spark, sf_dir, "entities"))


def _now():
    return F.lit(NOW).cast("timestamp")


def ent_current(spark, sf_dir):
    return _current(spark, sf_dir).select("id", "row_id", "kind", F.size(F.coalesce("names", F.array().cast("array<string>"))).alias("n_names"))


def ent_stats(spark, sf_dir):
    n = lambda c: F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)))
    return _current(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), n("wiki_links").alias("links"), n("claims").alias("claims"), n("evidence").alias("evidence"))


def ent_topics(spark, sf_dir):
    return _current(spark, sf_dir).select(F.explode("topics").alias("topic")).filter("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("entities")).orderBy(F.desc("entities"), "topic").limit(20)


def ent_age_percentiles(spark, sf_dir):
    days = F.floor((F.unix_micros(_now()) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000)
    p = lambda x: F.percentile("age", x)
    return _current(spark, sf_dir).select("kind", days.alias("age")).groupBy("kind").agg(F.round(p(0.5), 6).alias("p50"), F.round(p(0.9), 6).alias("p90"), F.max("age").alias("oldest"))


def ent_freshness(spark, sf_dir):
    return E.freshness(_current(spark, sf_dir), _now()).select("id", "kind", "score", "status")


def ent_expired(spark, sf_dir):
    age = F.floor((F.unix_micros(_now()) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000)
    rows = _current(spark, sf_dir).withColumn("days", age).withColumn("most", E.by_kind(E.EXPIRES, 365))
    return rows.filter("days > most").select("id", "kind", "days", "most")


def ent_links_in(spark, sf_dir):
    return E.links(_current(spark, sf_dir)).groupBy("target").agg(F.count(F.lit(1)).alias("inbound"))


def ent_dead_links(spark, sf_dir):
    return E.dead_links(_current(spark, sf_dir), table(spark, sf_dir, "entities"))


def ent_orphans(spark, sf_dir):
    return E.orphans(_current(spark, sf_dir))


def ent_contradictions(spark, sf_dir):
    return E.contradictions(E.claims(_current(spark, sf_dir)))


def ent_merge_candidates(spark, sf_dir):
    return E.merge_candidates(_current(spark, sf_dir))


def ent_split_candidates(spark, sf_dir):
    return E.split_candidates(_current(spark, sf_dir))


def ent_stale_assertions(spark, sf_dir):
    return E.stale_assertions(_current(spark, sf_dir))


def ent_search(spark, sf_dir):
    return E.search(_current(spark, sf_dir), "token budget")


def ent_resolve(spark, sf_dir):
    return E.resolve(_current(spark, sf_dir), "acoustics")


RULES = [("entities/person/%", "restricted"), ("entities/concept/%", "public"), ("entities/concept/%ledger%", "confidential"), ("entities/org/a%", "public")]


def ent_visible(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "pattern string, class string")
    return E.visible(E.classified(_current(spark, sf_dir), rules, "internal"), "internal").select("id", "class")


def ent_neighbours(spark, sf_dir):
    """What the ten most linked entities reach in two hops."""
    rows = _current(spark, sf_dir)
    edges = E.links(rows)
    hubs = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10).select(F.col("source").alias("id"))
    return E.neighbours(edges, hubs, 2)


def ent_sources(spark, sf_dir):
    """Distinct sources that support each entity: provenance and active assertions."""
    rows = _current(spark, sf_dir)
    told = rows.select("id", F.lit("extracted").alias("type"), F.explode("provenance.extracted_from").alias("ref"))
    sure = rows.select("id", F.explode("identity_assertions").alias("a")).filter("a.status = 'active'").select("id", F.col("a.source_system").alias("type"), F.col("a.source_id").alias("ref"))
    return told.unionByName(sure).filter("ref is not null").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("sources"), F.countDistinct("type").alias("types"))


def ent_findings(spark, sf_dir):
    """One row per rule and entity that breaks it."""
    rows = _current(spark, sf_dir)
    rules = {
        "bad_id": ~F.col("id").rlike(r"^[a-z][a-z0-9-]{0,63}:[a-z0-9][a-z0-9-]{0,127}$"),
        "no_name": F.coalesce(F.size("names"), F.lit(0)) <= 0,
        "long_summary": F.length("summary") > 200,
        "kind_differs": ~F.startswith("id", F.concat(F.col("kind"), F.lit(":"))),
        "one_source": F.coalesce(F.size(F.array_distinct(F.col("evidence.source_id"))), F.lit(0)) == 1,
        "updated_before_created": F.col("updated_at") < F.col("created_at"),
    }
    hits = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(hits).alias("rule"))


_CUR = """with cur as (select * exclude (_r) from (select *, row_number() over (partition by id order by updated_at desc nulls last, row_id desc) as _r from entities where id is not null) where _r = 1)
"""
_LINKS = _CUR + """, links as (select distinct source, target from (select id as source, lower(trim(t)) as target from (select id, unnest(wiki_links) as t from cur) where t is not null) where target <> '' and not starts_with(target, 'https://'))
"""
_HALF = "case kind when 'org' then 180 when 'person' then 90 else 365 end"
_AGE = f"floor((epoch_us(timestamp '{NOW}') - epoch_us(updated_at)) / 86400000000.0)::bigint"
_DAYS = f"greatest((epoch_us(timestamp '{NOW}') - epoch_us(last_verified_at)) / 86400000000.0, 0)"

QUERIES = {f.__name__: f for f in [ent_current, ent_stats, ent_topics, ent_age_percentiles, ent_freshness, ent_expired, ent_links_in, ent_dead_links, ent_orphans, ent_contradictions, ent_merge_candidates, ent_split_candidates, ent_stale_assertions, ent_search, ent_resolve, ent_visible, ent_neighbours, ent_sources, ent_findings]}

SQL = {
    "ent_current": _CUR + "select id, row_id, kind, coalesce(len(names), 0) as n_names from cur",
    "ent_stats": _CUR + "select kind, count(*) as entities, sum(coalesce(len(wiki_links), 0))::bigint as links, sum(coalesce(len(claims), 0))::bigint as claims, sum(coalesce(len(evidence), 0))::bigint as evidence from cur group by kind",
    "ent_topics": _CUR + "select topic, count(*) as entities from (select unnest(topics) as topic from cur) where topic is not null group by topic order by entities desc, topic limit 20",
    "ent_age_percentiles": _CUR + f"select kind, round(quantile_cont(age, 0.5), 6) as p50, round(quantile_cont(age, 0.9), 6) as p90, max(age) as oldest from (select kind, {_AGE} as age from cur) group by kind",
    "ent_freshness": _CUR + f"""select id, kind, round(s, 3) as score, case when s is null then 'never verified' when s < 0.3 then 'stale' when s < 0.7 then 'aging' else 'fresh' end as status
from (select id, kind, case when last_verified_at is not null then greatest(0.0::double, 1.0::double - {_DAYS} / (2.0 * {_HALF})) end as s from cur)""",
    "ent_expired": _CUR + f"select * from (select id, kind, {_AGE} as days, {_HALF} as most from cur) where days > most",
    "ent_links_in": _LINKS + "select target, count(*) as inbound from links group by target",
    "ent_dead_links": _LINKS + "select source, target from links where target not in (select lower(id) from entities where id is not null)",
    "ent_orphans": _LINKS + "select id, kind from cur where coalesce(len(claims), 0) = 0 and coalesce(len(evidence), 0) = 0 and coalesce(trim(concept.statement), '') = '' and lower(id) not in (select target from links)",
    "ent_contradictions": _CUR + """, c as (select id, unnest(claims) as c from cur), m as (select id, c.metric as metric, c.role as role, c.as_of as as_of, unnest(c.measurements) as m from c),
k as (select id, lower(trim(coalesce(metric, 'n/a'))) as metric, lower(trim(coalesce(role, 'n/a'))) as role, lower(trim(coalesce(as_of, 'n/a'))) as as_of,
 case lower(trim(coalesce(m.cp_type, 'n/a'))) when 'counterparty' then 'cp' else lower(trim(coalesce(m.cp_type, 'n/a'))) end as cp_type, lower(trim(coalesce(m.tenor, 'n/a'))) as tenor,
 case lower(trim(coalesce(m.status, 'n/a'))) when 'est' then 'estimated' when 'act' then 'actual' else lower(trim(coalesce(m.status, 'n/a'))) end as status, m.value as value from m)
select id, metric, role, cp_type, tenor, status, as_of, count(distinct coalesce(round(try_cast(value as double), 9)::varchar, 's:' || value, 'null')) as "values", count(*) as measurements from k group by all having "values" > 1""",
    "ent_merge_candidates": _CUR + "select kind, name, count(*) as ids, min(id) as first_id, max(id) as last_id from (select distinct kind, id, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') as name from (select kind, id, unnest(names) as n from cur)) where name <> '' group by kind, name having count(*) > 1",
    "ent_split_candidates": _CUR + "select * from (select id, kind, coalesce(len(list_distinct(list_filter(list_transform(claims, lambda x: x.metric), lambda x: x is not null))), 0) as metrics, coalesce(len(list_distinct(list_filter(topics, lambda x: x is not null))), 0) as topics from cur) where metrics > 1 or topics > 2",
    "ent_stale_assertions": _CUR + "select id, a.assertion_id as assertion_id, coalesce(a.superseded_by, '') as superseded_by from (select id, identity_assertions as all_a, unnest(identity_assertions) as a from cur) where a.status = 'superseded' and not coalesce(list_contains(list_transform(all_a, lambda x: x.assertion_id), a.superseded_by), false)",
    "ent_search": _CUR + """select * from (select id, kind, least(round((case when contains(lower(id), 'token budget') then 0.5 else 0 end) + (case when len(list_filter(names, lambda x: contains(lower(x), 'token budget'))) > 0 then 0.4 else 0 end)
 + (case when contains(lower(summary), 'token budget') then 0.15 else 0 end) + (case when contains(lower(concept.statement), 'token budget') then 0.15 else 0 end) + 0.05 * coalesce(len(list_filter(topics, lambda x: contains(lower(x), 'token budget'))), 0), 6), 1.0)::double as score from cur) where score > 0 order by score desc, id limit 20""",
    "ent_resolve": _CUR + """select id, score from (select id, round(case when lower(id) = 'acoustics' then 1.0 when lower(split_part(id, ':', -1)) = 'acoustics' then 0.95 when len(list_filter(names, lambda n: lower(n) = 'acoustics')) > 0 then 0.9
 when len(list_filter(names, lambda n: contains(lower(n), 'acoustics'))) > 0 then least(0.89::double, 0.5::double + 0.39::double * list_max(list_transform(list_filter(names, lambda n: contains(lower(n), 'acoustics')), lambda n: 9.0::double / greatest(length(n), 1))))
 when contains(lower(summary), 'acoustics') then 0.3 end::double, 6) as score from cur) where score is not null order by score desc, id limit 10""",
    "ent_visible": _CUR + """, r(pattern, class) as (values ('entities/person/%', 'restricted'), ('entities/concept/%', 'public'), ('entities/concept/%ledger%', 'confidential'), ('entities/org/a%', 'public')),
h as (select cur.id, r.class, row_number() over (partition by cur.id order by length(pattern) desc, class desc) as k from cur join r on 'entities/' || kind || '/' || split_part(id, ':', -1) like pattern)
select cur.id, coalesce(h.class, 'internal') as class from cur left join h on h.id = cur.id and h.k = 1 where coalesce(h.class, 'internal') in ('public', 'internal')""",
    "ent_neighbours": _LINKS + """, hubs as (select source as id from (select source, count(*) as n from links group by source order by n desc, source limit 10)),
one as (select distinct target as id from links where source in (select id from hubs)), two as (select distinct target as id from links where source in (select id from one where id not in (select id from hubs)))
select id, 0 as hops from hubs union all select id, 1 from one where id not in (select id from hubs) union all select id, 2 from two where id not in (select id from hubs) and id not in (select id from one)""",
    "ent_sources": _CUR + """select id, count(*) as sources, count(distinct type) as types from (select distinct * from (select id, 'extracted' as type, unnest(provenance.extracted_from) as ref from cur
 union all select id, a.source_system, a.source_id from (select id, unnest(identity_assertions) as a from cur) where a.status = 'active') where ref is not null) group by id""",
    "ent_findings": _CUR + """select id, 'bad_id' as rule from cur where not regexp_matches(id, '^[a-z][a-z0-9-]{0,63}:[a-z0-9][a-z0-9-]{0,127}$') union all select id, 'no_name' from cur where coalesce(len(names), 0) = 0
union all select id, 'long_summary' from cur where length(summary) > 200 union all select id, 'kind_differs' from cur where not starts_with(id, kind || ':')
union all select id, 'one_source' from cur where len(list_distinct(list_transform(evidence, lambda x: coalesce(x.source_id, 'null')))) = 1 union all select id, 'updated_before_created' from cur where updated_at < created_at""",
}
