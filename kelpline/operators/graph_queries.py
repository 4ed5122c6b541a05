"""Queries over links and events and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.operators import entities as E
from kelpline.operators import files as X
from kelpline.operators import graph as G
from kelpline.operators.entity_queries import _CUR
from kelpline.session import scratch_dir, stored
from kelpline.streaming import events as S
from kelpline.tables import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entity_edges(E.current(table(spark, sf_dir, "entities")))


def _hubs(edges: DataFrame, n: int = 5) -> DataFrame:
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(n)


def graph_edges(spark, sf_dir):
    return G.damped(_edges(spark, sf_dir))


def graph_degrees(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("degree"))


def graph_traverse(spark, sf_dir):
    """What the five most referred ids lead to within two hops."""
    edges = _edges(spark, sf_dir)
    start = _hubs(edges).select(F.col("target").alias("id"), F.lit(1.0).alias("relevance"))
    return G.traverse(edges, start, depth=2)


def graph_impact(spark, sf_dir):
    """What refers to the last updated ten entities."""
    rows = E.current(table(spark, sf_dir, "entities"))
    changed = rows.orderBy(F.desc("updated_at"), "id").limit(10).select("id")
    return G.impact(G.entity_edges(rows), changed, 2)


def graph_communities(spark, sf_dir):
    labels = G.communities(_edges(spark, sf_dir))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))


def graph_clusters(spark, sf_dir):
    """Of each community of at least five: its links inside and to others, and the kind that seven of ten share, else its two most common topics."""
    rows = stored(E.current(table(spark, sf_dir, "entities")).select("id", "kind", "topics"), "kinds")
    edges = _edges(spark, sf_dir)
    labels = stored(G.communities(edges), "labels")
    return G.cluster_names(labels, edges, rows, 5)


def graph_meta(spark, sf_dir):
    """Edges between kinds of entities, counted and weighed."""
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return _edges(spark, sf_dir).groupBy(kind(F.col("source")).alias("from_kind"), kind(F.col("target")).alias("to_kind"), "kind").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


def graph_imports(spark, sf_dir):
    """The files that imports of each language resolve to within their corpus."""
    files = X.latest(table(spark, sf_dir, "source_files"))
    return G.suffix_matches(X.imports(files), files.select("corpus_id", "path"))


def graph_tests(spark, sf_dir):
    """Files of one corpus with the same stem in several languages or folders."""
    stem = F.regexp_replace(F.lower(F.regexp_extract("path", r"([^/]*?)([.][^/]*)?$", 1)), "[^a-z0-9]", "")
    rows = X.latest(table(spark, sf_dir, "source_files")).withColumn("stem", stem)
    return rows.groupBy("corpus_id", "stem").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("lang").alias("langs")).filter("files > 1")


def ev_consolidated(spark, sf_dir):
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return S.consolidated(table(spark, sf_dir, "events")).select("user_id", "events", "types", fmt("first_ts"), fmt("last_ts"), "last_type", "confidence")


def ev_daily(spark, sf_dir):
    return S.daily(table(spark, sf_dir, "events"))


def ev_daily_stream(spark, sf_dir):
    return S.run_available(S.daily_stream(S.stream_of(spark, sf_dir)), "update", ["day", "event_type"]).withColumn("value", F.round("value", 4))


def ev_distinct_stream(spark, sf_dir):
    got = S.run_available(S.distinct_stream(S.stream_of(spark, sf_dir)), "append")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"))


def ev_log(spark, sf_dir):
    """Purchases and errors of the log's last thirty days, read back from JSON lines by day."""
    events = table(spark, sf_dir, "events")
    folder = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    S.append_events(events, folder)
    last = events.agg(F.max("ts").cast("timestamp").alias("t")).select(F.unix_seconds("t")).first()[0]
    fields = "event_id bigint, user_id bigint, event_type string, value double"
    return S.read_events(spark, folder, fields, (last or 0) - 30 * 86400, F.col("event_type").isin("purchase", "error")).select("event_id", "user_id", "event_type", "ts")


def ev_revisions(spark, sf_dir):
    """The newest event of each user and type."""
    return S.latest_revisions(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type", "revisions", "event_id", "value")


def ev_triggers_stream(spark, sf_dir):
    """How often each user's events are consolidated, and why."""
    got = S.run_available(S.triggers(S.stream_of(spark, sf_dir)), "append")
    return got.groupBy("user_id", "reason").agg(F.count(F.lit(1)).alias("times"))


def ev_sessions(spark, sf_dir):
    """Sessions of each user: events at most six hours apart."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


def ev_as_of(spark, sf_dir):
    """Each event with the type of its user's directly preceding event, which may be the same type, as its SQL counts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before_type", F.lag("event_type").over(w)).withColumn("gap_s", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1_000_000))
    return rows.groupBy("event_type", "before_type").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.max("gap_s"), F.lit(-1)).alias("longest_gap_s"))


def ev_props(spark, sf_dir):
    """The JSON properties: events and mean value per key value."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))


QUERIES = {f.__name__: f for f in [graph_edges, graph_degrees, graph_traverse, graph_impact, graph_communities, graph_clusters, graph_meta, graph_imports, graph_tests, ev_consolidated, ev_daily, ev_daily_stream, ev_distinct_stream, ev_log, ev_revisions, ev_triggers_stream, ev_sessions, ev_as_of, ev_props]}

_EDGES = _CUR + """, raw as (select id as source, unnest(wiki_links) as t, 'links_to' as kind, 0.5::double as weight from cur union all select id, unnest(list_transform(evidence, lambda x: x.source_id)), 'references', 0.4::double from cur
 union all select id, unnest(person.affiliations), 'depends_on', 0.4::double from cur),
edges as (select distinct source, target, kind, weight from (select source, lower(trim(t)) as target, kind, weight from raw where t is not null) where target <> '' and not starts_with(target, 'https://') and target <> source)
"""
_VOTES = "ways as (select source, target, sum(weight) as weight from (select source, target, weight from edges union all select target, source, weight from edges) group by 1, 2), l0 as (select distinct source as id, source as label from ways)" + "".join(
    f""", t{i} as (select id, label, round(sum(weight), 6) as w from (select source as id, label, weight from ways join l{i - 1} on id = target union all select id, label, 0.25::double from l{i - 1}) group by 1, 2), l{i} as (select id, arg_min(label, struct_pack(w := -w, l := label)) as label from t{i} group by 1)"""
    for i in range(1, 16)
)
_NAMED = _VOTES + """, s as (select label, count(*) as members from l15 group by 1 having count(*) >= 5), e as (select a.label as a, b.label as b from edges x join l15 a on a.id = x.source join l15 b on b.id = x.target),
i as (select a as label, count(*) as inside from e where a = b group by 1), c as (select label, count(*) as across from (select unnest([a, b]) as label from e where a <> b) group by 1),
k as (select label, arg_min(kind, struct_pack(n := -n, k := kind)) as kind, max(n) as n from (select label, kind, count(*) as n from l15 join cur using (id) group by 1, 2) group by 1),
p as (select label, string_agg(topic, ', ' order by n desc, topic) as topics from (select *, row_number() over (partition by label order by n desc, topic) as r from (select label, topic, count(*) as n from (select label, unnest(topics) as topic from l15 join cur using (id)) where topic is not null group by 1, 2)) where r <= 2 group by 1)
select label, members, coalesce(inside, 0) as inside, coalesce(across, 0) as across, case when k.n * 10 >= members * 7 then k.kind else coalesce(topics, label) end as name from s left join i using (label) left join c using (label) left join k using (label) left join p using (label)"""
_DAILY = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 4) as value from events group by 1, 2"
_FILES = "with f as (select * from (select *, row_number() over (partition by corpus_id, path order by indexed_at desc, hash desc nulls last, tokens desc) as k from source_files) where k = 1)\n"

SQL = {
    "graph_edges": _EDGES + ", d as (select target, kind, count(*) as n from edges group by 1, 2) select source, target, kind, round(case when n > 10 then weight / (1 + log2(n / 10.0::double)) else weight end, 6) as weight from edges join d using (target, kind)",
    "graph_communities": _EDGES + ", " + _VOTES + " select label, count(*) as members from l15 group by 1",
    "graph_clusters": _EDGES + ", " + _NAMED,
    "graph_degrees": _EDGES + "select target, kind, count(*) as degree from edges group by 1, 2",
    "graph_traverse": _EDGES + """, s as (select target as id, 1.0::double as r from (select target, count(*) as n from edges group by 1 order by n desc, target limit 5)),
a as (select target as id, max(round(r * weight * 0.65::double, 9)) as r from s join edges on id = source where round(r * weight * 0.65::double, 9) >= 0.05 group by 1),
b as (select target as id, max(round(r * weight * 0.65::double, 9)) as r from a join edges on id = source where round(r * weight * 0.65::double, 9) >= 0.05 group by 1)
select id, max(r) as relevance from (select * from s union all select * from a union all select * from b) group by 1""",
    "graph_impact": _EDGES + """, c as (select id from cur order by updated_at desc, id limit 10), hubs as (select target as id from edges group by 1 having count(*) > 10),
a as (select distinct source as id from edges where target in (select id from c) and source not in (select id from c)),
b as (select distinct source as id from edges where target in (select id from a where id not in (select id from hubs)) and source not in (select id from c) and source not in (select id from a))
select id, 1 as hops, round(1.0::double / 2, 6) as risk from a union all select id, 2, round(1.0::double / 3, 6) from b""",
    "graph_meta": _EDGES + "select split_part(source, ':', 1) as from_kind, split_part(target, ':', 1) as to_kind, kind, count(*) as edges, round(sum(weight), 4) as weight from edges group by 1, 2, 3",
    "graph_tests": _FILES + "select corpus_id, regexp_replace(lower(regexp_extract(path, '([^/]*?)([.][^/]*)?$', 1)), '[^a-z0-9]', '', 'g') as stem, count(*) as files, count(distinct lang) as langs from f group by 1, 2 having count(*) > 1",
    "ev_consolidated": "select user_id, count(*) as events, count(distinct event_type) as types, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts, arg_max(event_type, (ts, event_id)) as last_type, round(least(0.5::double + count(*) * 0.1::double, 0.95::double), 6) as confidence from events where user_id is not null group by 1",
    "ev_daily": _DAILY,
    "ev_daily_stream": _DAILY,
    "ev_distinct_stream": "select event_type, count(distinct event_id) as events, count(distinct event_id) as ids from events group by 1",
    "ev_log": "select event_id, user_id, event_type, floor(epoch(ts))::bigint as ts from events where event_type in ('purchase', 'error') and floor(epoch(ts))::bigint >= (select floor(epoch(max(ts)))::bigint - 30 * 86400 from events)",
    "ev_revisions": "select user_id, event_type, count(*) as revisions, arg_max(event_id, struct_pack(t := ts, e := event_id)) as event_id, arg_max(value, struct_pack(t := ts, e := event_id)) as value from events group by 1, 2",
    "ev_triggers_stream": "select user_id, 'no prior centroid' as reason, 1 as times from events where user_id is not null group by 1 union all select user_id, 'volume', floor((count(*) - 1) / 8.0)::bigint from events where user_id is not null group by 1 having count(*) > 8",
    "ev_sessions": "select user_id, count(*) as sessions, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(case when gap is null or gap >= 21600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events)) group by 1, 2) group by 1",
    "ev_as_of": "select event_type, before_type, count(*) as events, coalesce(max(gap), -1) as longest_gap_s from (select event_type, lag(event_type) over w as before_type, floor((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000000.0)::bigint as gap from events window w as (partition by user_id order by ts, event_id)) group by 1, 2",
    "ev_props": "select (props->>'$.k')::bigint as k, count(*) as events, round(avg(value), 6) as mean_value from events group by 1",
}
