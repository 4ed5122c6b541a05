"""Joins whose strategy is chosen by a measured size or by measured skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.session import stored

BROADCAST_ROWS, BROADCAST_CHARS = 20_000, 32 << 20
HOT_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether df has at most `rows` rows that hold at most `chars` characters. Reads no more than rows + 1 of them."""
    size = F.sum(F.length(F.to_json(F.struct("*"))))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("chars")).first()
    return got["n"] <= rows and got["chars"] <= chars


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """A broadcast hint behind a measured size; a larger side keeps the shuffle join. df is read twice, so pass a stored table."""
    return F.broadcast(df) if small(df, rows, chars) else df


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(keys, _parts) of the keys with more than hot_rows rows, or None; counted with map-side combine, broadcast only if they are few."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = stored(counts.select(*keys, F.ceil(F.col("_n") / max(1, hot_rows)).cast("int").alias("_parts")), "hot_keys")
    return None if hot.isEmpty() else broadcast_if_small(hot)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column, hot_rows: int = HOT_ROWS, hot: DataFrame | None | bool = True) -> DataFrame:
    """left join right on keys where one key may hold a large part of left.

    A key with more than hot_rows rows in left is split by `spread` into as many
    parts as its rows fill; only its few rows of right are repeated. right
    should hold few rows per key. how: inner, left, left_semi or left_anti.
    left is read twice, so pass a stored table, or the hot_keys counted before.
    """
    if hot is True:
        hot = hot_keys(left, keys, hot_rows)
    if hot is None:
        return left.join(right, keys, how)
    parts = F.coalesce("_parts", F.lit(1))
    salted = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
