"""Every file but prose is learned, however long, and shards share what they learn."""

from kelpline.llm import handwritten as H
from pyspark.sql import functions as F


def hand(i):
    return f"def load_{i}(rows, limit={i}):\n    seen = set()\n    for row in rows:\n        seen.add(row)\n    return sorted(seen)[:limit]\n"


def emitted(i):
    return "// Code generated by fieldgen. DO NOT EDIT.\n" + "".join(f"export const getField{i}_{j} = (m) => m.fields_[{j}];\n" for j in range(1500))


def test_long_files_are_learned_in_shards(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 40, raising=False)
    monkeypatch.setattr(H, "STEPS", 4000, raising=False)
    made = [(f"c{i % 8}", f"src/gen{i}.ts", emitted(i), "typescript") for i in range(40)]
    files = made + [(f"c{i % 8}", f"src/load{i}.py", hand(i), "python") for i in range(80)]
    assert min(len(f[2]) for f in made) > 1 << 16
    sources = spark.createDataFrame(files, "corpus_id string, path string, content string, lang string").withColumn("indexed_at", F.timestamp_seconds(F.lit(1))).withColumn("hash", F.lit("h"))
    got = {(r.corpus_id, r.file_id) for r in H.not_by_hand(sources.select("corpus_id", F.col("path").alias("file_id")), sources).collect()}
    assert got == {f[:2] for f in made}
