"""Ranks over a global sort, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.session import stored


def with_global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with its 0-based position in the order of `order` (which should be unique).

    Range-partitions and sorts, stores the sorted parts, counts each part and
    adds the sum of the counts before it. The counts are one row per part.
    """
    position = F.monotonically_increasing_id()
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", position), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # one row per partition
    before, total = [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        before.append((row["_part"], total))
        total += row["_n"]
    if not before:
        return parts.withColumn(name, F.lit(0).cast("bigint")).drop("_at")
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part bigint, _before bigint"))  # one row per partition
    return parts.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + within).drop("_at", "_part", "_before")
