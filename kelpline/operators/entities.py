"""Operators over entities: current rows, search, links, audits, freshness, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.plans.joins import broadcast_if_small

#: Days after which half of an entity's freshness is gone, and after which it is expired, by kind.
HALF_LIFE = {"org": 180, "person": 90, "concept": 365}
EXPIRES = {"org": 180, "person": 90, "concept": 365}
LEVELS = ["public", "internal", "confidential", "restricted"]
#: Other words for the parts of a claim's key.
SYNONYMS = {"status": {"est": "estimated", "act": "actual"}, "cp_type": {"counterparty": "cp"}}


def current(entities: DataFrame) -> DataFrame:
    """The row of each id with the latest updated_at; ties go to the larger row_id. Null ids are left out."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), F.desc("row_id"))
    return entities.filter("id is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def by_kind(values: dict, default: int) -> Column:
    column = F.lit(default)
    for kind, v in values.items():
        column = F.when(F.col("kind") == kind, v).otherwise(column)
    return column


def freshness(rows: DataFrame, now: Column, at: str = "last_verified_at") -> DataFrame:
    """rows with score and status: 1 at once, 0 after two half-lives; never verified is its own status, not stale."""
    days = F.greatest((F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(86_400_000_000.0), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - days / (2.0 * by_kind(HALF_LIFE, 365)))
    status = F.when(score < 0.3, "stale").when(score < 0.7, "aging").when(score.isNotNull(), "fresh").otherwise("never verified")
    return rows.withColumn("score", F.when(F.col(at).isNotNull(), F.round(score, 3))).withColumn("status", F.when(F.col(at).isNull(), "never verified").otherwise(status))


def links(rows: DataFrame) -> DataFrame:
    """(source, target), distinct: wiki_links as delivered, trimmed and lower-cased."""
    return rows.select(F.col("id").alias("source"), F.explode("wiki_links").alias("t")).filter("t is not null").select("source", F.lower(F.trim("t")).alias("target")).filter("target <> '' and not startswith(target, 'https://')").distinct()


def claims(rows: DataFrame) -> DataFrame:
    """One row per measurement, with the parts of its key in one spelling; a missing part is n/a."""
    part = lambda c, name=None: _same_word(F.coalesce(F.col(c), F.lit("n/a")), name)
    each = rows.select("id", F.explode("claims").alias("c")).select("id", "c.metric", "c.role", "c.as_of", F.explode("c.measurements").alias("m"))
    each = each.select("id", "metric", "role", "as_of", "m.cp_type", "m.tenor", "m.status", "m.source", "m.value")
    return each.select("id", part("metric").alias("metric"), part("role").alias("role"), part("as_of").alias("as_of"), part("cp_type", "cp_type").alias("cp_type"), part("tenor").alias("tenor"), part("status", "status").alias("status"), "source", "value")


def _same_word(c: Column, name: str | None) -> Column:
    out = F.lower(F.trim(c))
    for word, same in SYNONYMS.get(name or "", {}).items():
        out = F.when(out == word, same).otherwise(out)
    return out


CLAIM_KEY = ["id", "metric", "role", "cp_type", "tenor", "status", "as_of"]


def contradictions(measured: DataFrame) -> DataFrame:
    """Claim keys with more than one value; numbers compare as numbers."""
    as_double = F.expr("try_cast(value as double)")
    typed = F.coalesce(F.round(as_double, 9).cast("string"), F.concat(F.lit("s:"), F.col("value")), F.lit("null"))
    return measured.withColumn("typed", typed).groupBy(*CLAIM_KEY).agg(F.countDistinct("typed").alias("values"), F.count(F.lit(1)).alias("measurements")).filter("values > 1")


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def merge_candidates(rows: DataFrame) -> DataFrame:
    """(kind, name, ids): normalised names that several ids bear. Counted with map-side combine; the ids are not collected."""
    names = rows.select("kind", "id", F.explode("names").alias("n")).select("kind", "id", normal_name(F.col("n")).alias("name")).filter("name <> ''").distinct()
    return names.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("ids > 1")


def merge_slugs(rows: DataFrame) -> DataFrame:
    """(kind, name, ids): normalised slugs, without a mark of five characters at the end, that several ids share."""
    slug = normal_name(F.regexp_replace(F.split_part(F.lower("id"), F.lit(":"), F.lit(2)), "-[a-z0-9]{5}$", ""))
    return rows.select("kind", "id", slug.alias("name")).filter("name <> ''").groupBy("kind", "name").agg(F.countDistinct("id").alias("ids")).filter("ids > 1")


def split_candidates(rows: DataFrame, metrics: int = 1, topics: int = 2) -> DataFrame:
    """Entities with more distinct metrics or topics than one subject has."""
    m = F.size(F.array_distinct(F.filter(F.coalesce(F.col("claims.metric"), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    t = F.size(F.array_distinct(F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return rows.select("id", "kind", m.alias("metrics"), t.alias("topics")).filter((F.col("metrics") > metrics) | (F.col("topics") > topics))


def dead_links(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Links to ids that no row has."""
    return links(rows).join(known.select(F.lower("id").alias("target")).distinct(), "target", "left_anti").select("source", "target")


def orphans(rows: DataFrame) -> DataFrame:
    """Entities without inbound links, claims, evidence or statement."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    bare = rows.filter(empty("claims") & empty("evidence") & (F.coalesce(F.trim("concept.statement"), F.lit("")) == ""))
    inbound = links(rows).select(F.col("target").alias("low")).distinct()
    return bare.withColumn("low", F.lower("id")).join(inbound, "low", "left_anti").select("id", "kind")


def stale_assertions(rows: DataFrame) -> DataFrame:
    """Superseded identity assertions whose successor the entity does not have."""
    a = rows.select("id", "identity_assertions", F.explode("identity_assertions").alias("a"))
    has = F.coalesce(F.exists("identity_assertions", lambda x: x["assertion_id"] == F.col("a.superseded_by")), F.lit(False))
    return a.filter((F.col("a.status") == "superseded") & ~has).select("id", "a.assertion_id", F.coalesce("a.superseded_by", F.lit("")).alias("superseded_by"))


def substring_score(query: str) -> Column:
    """.5 for the id, .4 for a name, .15 for the summary and the statement, .05 for each topic that holds the query; 1 at most."""
    q = F.lit(query.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    any_of = lambda c: F.coalesce(F.exists(F.col(c), lambda x: has(x)), F.lit(False))
    topics = F.coalesce(F.size(F.filter("topics", lambda x: has(x))), F.lit(0))
    s = F.when(has("id"), 0.5).otherwise(0.0) + F.when(any_of("names"), 0.4).otherwise(0.0) + F.when(has("summary"), 0.15).otherwise(0.0) + F.when(has("concept.statement"), 0.15).otherwise(0.0) + 0.05 * F.greatest(topics, F.lit(0))
    return F.least(F.round(s, 6), F.lit(1.0))


def search(rows: DataFrame, query: str, top: int = 20) -> DataFrame:
    """The best rows for a query; a blank query finds nothing."""
    if not query.strip():
        return rows.limit(0).select("id", "kind").withColumn("score", F.lit(0.0))
    return rows.select("id", "kind", substring_score(query).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(top)


def resolve(rows: DataFrame, query: str, top: int = 10) -> DataFrame:
    """Ranked tiers: 1 id, .95 slug, .9 name, .5 to .89 for a part of a name by its share, .3 for the summary."""
    q = query.strip().lower()
    part = F.array_max(F.transform("names", lambda n: F.when(F.contains(F.lower(n), F.lit(q)), F.lit(float(len(q))) / F.greatest(F.length(n), F.lit(1)))))
    score = (
        F.when(F.lower("id") == q, 1.0)
        .when(F.lower(F.element_at(F.split("id", ":"), -1)) == q, 0.95)
        .when(F.coalesce(F.exists("names", lambda n: F.lower(n) == q), F.lit(False)), 0.9)
        .when(part.isNotNull(), F.least(F.lit(0.89), 0.5 + 0.39 * part))
        .when(F.contains(F.lower("summary"), F.lit(q)), 0.3)
    )
    return rows.select("id", F.round(score, 6).alias("score")).filter("score is not null").orderBy(F.desc("score"), "id").limit(top)


def classified(rows: DataFrame, rules: DataFrame, default: str = "restricted") -> DataFrame:
    """rows with `class`: that of the longest matching pattern of rules (pattern, class), else the default.

    Patterns are SQL LIKE patterns on entities/kind/slug; rules is broadcast
    only if it is counted to be small.
    """
    path = F.concat_ws("/", F.lit("entities"), "kind", F.element_at(F.split("id", ":"), -1))
    hits = rows.select("id", path.alias("path")).join(broadcast_if_small(rules, 1000), F.expr("path like pattern"))
    best = hits.groupBy("id").agg(F.max(F.struct(F.length("pattern").alias("n"), "class")).alias("b")).select("id", F.col("b.class").alias("_c"))
    return rows.join(best, "id", "left").withColumn("class", F.coalesce("_c", F.lit(default))).drop("_c")


def visible(rows: DataFrame, cap: str) -> DataFrame:
    """The rows a caller may see; an unknown class counts as the highest, an unknown cap as the lowest."""
    rank = lambda c, other: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), c), F.lit(0)), F.lit(other))
    return rows.filter(rank(F.col("class"), 4) <= (LEVELS.index(cap) + 1 if cap in LEVELS else 1))


def neighbours(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops): what links reach from start (id) in at most depth hops. One join per hop against what is not yet seen."""
    from kelpline.session import stored

    seen = start.select("id", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        new = frontier.select(F.col("id").alias("source")).join(edges, "source").select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        frontier = stored(new, "frontier")
        seen = seen.unionByName(frontier)
    return seen
