"""The event log: an append-only log of JSON lines by day, consolidation as a batch and as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.session import scratch_dir


def consolidated(events: DataFrame) -> DataFrame:
    """One row per hint (user_id): events, distinct types, first and last time, last type, confidence min(.5 + .1 n, .95). Null hints are left out."""
    n = F.count(F.lit(1))
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.filter("user_id is not null").groupBy("user_id").agg(n.alias("events"), F.countDistinct("event_type").alias("types"), F.min("ts").alias("first_ts"), last.alias("l"), F.round(F.least(F.lit(0.5) + n * 0.1, F.lit(0.95)), 6).alias("confidence")).select("user_id", "events", "types", "first_ts", F.col("l.ts").alias("last_ts"), F.col("l.event_type").alias("last_type"), "confidence")


def daily(events: DataFrame) -> DataFrame:
    """Events, users and the sum of values of each type and day."""
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    return events.groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("value", 4).alias("value"))


def append_events(events: DataFrame, folder: str) -> None:
    """Append events (ts, and any other columns) to the log in folder: JSON lines, a folder for each UTC day; ts as whole seconds."""
    line = F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), *[c for c in events.columns if c != "ts"]))
    events.filter("ts is not null").select(line.alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day")).write.mode("append").partitionBy("day").text(folder)


def read_events(spark: SparkSession, folder: str, fields: str, since: int = 0, hint: Column | None = None) -> DataFrame:
    """The events of a log from `since` (seconds) on, with the given fields, that satisfy hint.

    Lines that are no JSON object, or whose ts is not a number, are skipped.
    Folders of days before `since` are not read.
    """
    lines = spark.read.text(folder).filter(F.col("day") >= F.date_format(F.timestamp_seconds(F.lit(since)), "yyyy-MM-dd"))
    number = F.get_json_object("value", "$.ts").try_cast("double")
    plain = F.regexp_like("value", F.lit(r'"ts"\s*:\s*-?[0-9]'))
    good = lines.filter(F.trim("value").startswith("{") & plain & (number >= since))
    parsed = good.select(F.from_json("value", f"ts bigint, {fields}").alias("e")).filter("e.ts is not null").select("e.*")
    return parsed.filter(hint) if hint is not None else parsed


def latest_revisions(events: DataFrame, by: list[str]) -> DataFrame:
    """Of each external id the newest event, ties to the larger event_id; with map-side combine."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("revisions"), F.max(F.struct("ts", "event_id", "value")).alias("m")).select(*by, "revisions", "m.event_id", "m.value")


def stream_of(spark: SparkSession, folder: str, name: str = "events", schema: str | None = None) -> DataFrame:
    """The table's files as a stream, one a micro-batch; new files in the folder become new batches."""
    schema = schema or spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", 1).parquet(folder)


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Process all that is available and give the result table.

    Each batch is written to a folder of its own number, so a repeated batch
    replaces itself. In update mode the last batch that names a key holds its
    row. at: a folder of the shared file system in which an earlier run is
    continued; by default a new one.
    """
    spark = stream.sparkSession
    at = at or f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    try:
        out = spark.read.parquet(f"{at}/out")
    except Exception as error:  # no batch at all
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode != "update":
        return out.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def distinct_stream(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event_id once within the look-back; the watermark bounds the state."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def daily_stream(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """daily as a stream in update mode: a day is dropped from the state, and closed, when the watermark has passed it."""
    at = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


def triggers(stream: DataFrame, volume: int = 8) -> DataFrame:
    """(user_id, reason, events) each time a user's events are to be consolidated: at the first, then at every `volume` new ones.

    The state of a user is whether there was a first one and how many are new; a
    user's events are read in parts, never held together.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, new = state.get if state.exists else (False, 0)
        for part in parts:
            n, out = len(part), []
            if not known and n:
                known, n = True, n - 1
                out.append((key[0], "no prior centroid", 1))
            out += [(key[0], "volume", volume)] * ((new + n) // volume)
            new = (new + n) % volume
            yield pd.DataFrame(out, columns=["user_id", "reason", "events"])
        state.update((known, new))

    rows = stream.filter("user_id is not null").select("user_id", "event_id")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, reason string, events int", "known boolean, new int", "append", "NoTimeout")
