"""Queries over corpora, symbols and consolidation and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions import vectors as V
from kelpline.operators import files as X
from kelpline.operators import retrieval as R
from kelpline.tables import table

#: The regular-expression fallback for symbols, by language and kind.
SYMBOLS = {
    "python": {"function": r"(?m)^(?:async )?def (\w+)", "class": r"(?m)^class (\w+)", "method": r"(?m)^[ \t]+(?:async )?def (\w+)"},
    "typescript": {"function": r"(?m)^(?:export )?(?:async )?function (\w+)", "class": r"(?m)^(?:export )?class (\w+)", "const": r"(?m)^(?:export )?const (\w+) ="},
    "javascript": {"function": r"(?m)^(?:export )?(?:async )?function (\w+)", "class": r"(?m)^(?:export )?class (\w+)", "const": r"(?m)^(?:export )?const (\w+) ="},
    "rust": {"function": r"(?m)^[ \t]*(?:pub )?fn (\w+)", "struct": r"(?m)^(?:pub )?struct (\w+)", "impl": r"(?m)^impl (\w+)"},
    "go": {"function": r"(?m)^func (\w+)", "method": r"(?m)^func \([^)]*\) (\w+)", "type": r"(?m)^type (\w+)"},
    "java": {"class": r"(?m)^public (?:final )?class (\w+)", "method": r"(?m)^[ \t]+public (?:static )?[\w<>\[\]]+ (\w+)\("},
}


def _named(kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def symbols(files: DataFrame) -> DataFrame:
    """(corpus_id, path, kind, name): distinct top symbols by the language's forms."""
    found = F.array().cast("array<struct<kind:string,name:string>>")
    for lang, forms in SYMBOLS.items():
        each = [_named(kind, F.regexp_extract_all("content", F.lit(form), 1)) for kind, form in forms.items()]
        found = F.when(F.col("lang") == lang, F.concat(*each)).otherwise(found)
    return files.filter("content is not null").select("corpus_id", "path", F.explode(found).alias("s")).select("corpus_id", "path", "s.kind", "s.name").distinct()


def file_symbols(spark, sf_dir):
    return symbols(X.latest(table(spark, sf_dir, "source_files"))).groupBy("corpus_id", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("name").alias("names"))


def symbol_prefixes(spark, sf_dir):
    """Groups of three or more symbols of a corpus with the same first camel-case word of three letters or more."""
    prefix = F.regexp_extract("name", r"^([A-Z][a-z]{2,})[A-Z]", 1)
    rows = symbols(X.latest(table(spark, sf_dir, "source_files"))).withColumn("prefix", prefix).filter("prefix <> ''")
    return rows.groupBy("corpus_id", "prefix").agg(F.countDistinct("name").alias("names"), F.countDistinct("path").alias("files")).filter("names >= 3")


def symbol_shared(spark, sf_dir):
    """Types that several corpora declare."""
    rows = symbols(X.latest(table(spark, sf_dir, "source_files"))).filter("kind in ('class', 'type', 'struct')")
    return rows.groupBy("name").agg(F.countDistinct("corpus_id").alias("corpora"), F.count(F.lit(1)).alias("places")).filter("corpora > 1")


def corpora_visible(spark, sf_dir):
    """Active corpora that a caller with an internal cap may list; an unknown class is never visible."""
    return table(spark, sf_dir, "corpora").filter("lifecycle_state = 'active' and data_classification in ('public', 'internal')").select("corpus_id", "source_type", "data_classification", "model", "dims")


def corpora_prefix_collisions(spark, sf_dir):
    """Corpora whose id with a hyphen starts another's id: found by an equi-join on all id starts."""
    ids = table(spark, sf_dir, "corpora").select("corpus_id").distinct()
    parts = F.split("corpus_id", "-")
    starts = ids.filter(F.size(parts) > 1).select(F.col("corpus_id").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "-"))).alias("corpus_id"))
    return ids.join(starts, "corpus_id").select("corpus_id", "longer")


def upload_checks(spark, sf_dir):
    """Entries that do not fit their corpus: another model, other dims, a vector of another length, an unknown corpus."""
    corpora = table(spark, sf_dir, "corpora").select("corpus_id", F.col("model").alias("c_model"), F.col("dims").alias("c_dims"))
    rows = table(spark, sf_dir, "embedding_entries").join(corpora, "corpus_id", "left")
    rules = {"unknown corpus": F.col("c_dims").isNull(), "model": F.col("model") != F.col("c_model"), "dims": F.col("dims") != F.col("c_dims"), "length": F.size("embedding") != F.col("c_dims"), "no vector": F.col("embedding").isNull()}
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select("corpus_id", F.explode(hits).alias("rule")).groupBy("corpus_id", "rule").agg(F.count(F.lit(1)).alias("entries"))


def consolidation_due(spark, sf_dir):
    """Whether a corpus' summary is due: entries of the last 60 days against the centroid of those before.

    In order: no centroid yet, at least eight pending entries, a drift of .35
    or more between the two centroids; else no.
    """
    entries = R.usable_entries(table(spark, sf_dir, "embedding_entries"))
    last = table(spark, sf_dir, "embedding_entries").groupBy("corpus_id").agg(F.max("embedded_at").alias("last"))
    dated = entries.join(last, "corpus_id").withColumn("pending", F.col("embedded_at") > F.col("last") - F.expr("interval 60 days"))
    counts = dated.groupBy("corpus_id").agg(F.count_if("pending").alias("pending"), F.count_if(~F.col("pending")).alias("settled"))
    old = R.centroids(dated.filter("not pending"), "corpus_id")
    new = R.centroids(dated.filter("pending"), "corpus_id").withColumnRenamed("centroid", "fresh")
    both = counts.join(old, "corpus_id", "left").join(new, "corpus_id", "left").withColumn("drift", F.round(1 - V.cosine(F.col("centroid"), F.col("fresh")), 6))
    due = F.when(F.col("centroid").isNull(), "no centroid").when(F.col("pending") >= 8, "volume").when(F.col("drift") >= 0.35, "drift").otherwise("no")
    return both.select("corpus_id", "pending", "settled", F.coalesce("drift", F.lit(-1.0)).alias("drift"), due.alias("due"))


QUERIES = {f.__name__: f for f in [file_symbols, symbol_prefixes, symbol_shared, corpora_visible, corpora_prefix_collisions, upload_checks, consolidation_due]}

_FORMS = "case lang " + " ".join("when '" + lang + "' then list_concat(" + ", ".join(f"list_transform(regexp_extract_all(content, '{form}', 1), lambda n: {{'kind': '{kind}', 'name': n}})" for kind, form in forms.items()) + ")" for lang, forms in SYMBOLS.items()) + " end"
_SYMBOLS = f"""with f as (select * from (select *, row_number() over (partition by corpus_id, path order by indexed_at desc, hash desc nulls last, tokens desc) as k from source_files) where k = 1),
s as (select distinct corpus_id, path, s.kind as kind, s.name as name from (select corpus_id, path, unnest({_FORMS}) as s from f where content is not null))
"""
_OK = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"

SQL = {
    "file_symbols": _SYMBOLS + "select corpus_id, kind, count(*) as symbols, count(distinct name) as names from s group by 1, 2",
    "symbol_prefixes": _SYMBOLS + "select corpus_id, regexp_extract(name, '^([A-Z][a-z]{2,})[A-Z]', 1) as prefix, count(distinct name) as names, count(distinct path) as files from s where regexp_matches(name, '^([A-Z][a-z]{2,})[A-Z]') group by 1, 2 having count(distinct name) >= 3",
    "symbol_shared": _SYMBOLS + "select name, count(distinct corpus_id) as corpora, count(*) as places from s where kind in ('class', 'type', 'struct') group by 1 having count(distinct corpus_id) > 1",
    "corpora_visible": "select corpus_id, source_type, data_classification, model, dims from corpora where lifecycle_state = 'active' and data_classification in ('public', 'internal')",
    "corpora_prefix_collisions": "select a.corpus_id, b.corpus_id as longer from (select distinct corpus_id from corpora) a join (select distinct corpus_id from corpora) b on starts_with(b.corpus_id, a.corpus_id || '-')",
    "upload_checks": """with r as (select e.*, c.model as c_model, c.dims as c_dims from embedding_entries e left join corpora c using (corpus_id)),
h as (select corpus_id, unnest([case when c_dims is null then 'unknown corpus' end, case when model <> c_model then 'model' end, case when dims <> c_dims then 'dims' end, case when len(embedding) <> c_dims then 'length' end, case when embedding is null then 'no vector' end]) as rule from r)
select corpus_id, rule, count(*) as entries from h where rule is not null group by 1, 2""",
    "consolidation_due": f"""with l as (select corpus_id, max(embedded_at) as last from embedding_entries group by 1), d as (select corpus_id, embedding, embedded_at > last - interval 60 days as pending from embedding_entries join l using (corpus_id) where {_OK}),
n as (select corpus_id, count(*) filter (pending) as pending, count(*) filter (not pending) as settled from d group by 1), m as (select corpus_id, pending, i, avg(x) as x from (select corpus_id, pending, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from d) group by 1, 2, 3),
c as (select corpus_id, pending, list(x order by i) as v from m group by 1, 2), b as (select n.*, o.v as o, f.v as f from n left join c o on o.corpus_id = n.corpus_id and not o.pending left join c f on f.corpus_id = n.corpus_id and f.pending)
select corpus_id, pending, settled, coalesce(round(1 - list_cosine_similarity(o, f), 6), -1.0::double) as drift, case when o is null then 'no centroid' when pending >= 8 then 'volume' when round(1 - list_cosine_similarity(o, f), 6) >= 0.35 then 'drift' else 'no' end as due from b""",
}
