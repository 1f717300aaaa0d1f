"""Streaming forms of the event log operators (Structured Streaming).

Sinks and checkpoints are folders in the shared folder: a batch is written under its number, so one that is repeated after
a lost driver replaces itself, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deltaloom.sources.staging import stage_path


def read_events(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    """A file stream of Parquet events; ts becomes an instant so that a watermark can hold it."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of text lines, for `sources.logs.events`, which tells bad lines apart in a stream as in a batch."""
    return spark.readStream.text(path)


def window_counts(events: DataFrame, width: str, lateness: str) -> DataFrame:
    """(begin, event_type, n, total): tumbling windows; totals in decimals, so their order of adding is no matter."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(F.col("w.start").alias("begin"), "event_type", "n", F.col("total").cast("double").alias("total"))
    )


def deduplicated(events: DataFrame, key: str, lateness: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def commit_once(path: str):
    """A foreachBatch sink: a batch is written under its number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return write


def drain(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Runs a stream over what is there now; the rows of its batches with batch_id.  In complete mode the last batch holds
    all, and only that is returned."""
    spark = stream.sparkSession
    path, checkpoint = stage_path(spark, name), stage_path(spark, name + "-checkpoint")
    query = stream.writeStream.foreachBatch(commit_once(path)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("batch_id", "long") if "batch_id" not in stream.columns else stream.schema
    out = spark.read.schema(schema).parquet(path)
    if mode != "complete":
        return out
    last = out.agg(F.max("batch_id").alias("_last"))  # one row
    return out.join(F.broadcast(last), F.col("batch_id") == F.col("_last"), "left_semi").drop("batch_id")


#: A run's states and what leads from one to the next.
RUNS = {"": {"start": "running"}, "running": {"ok": "ok", "failed": "failed", "step": "running", "lost": "unknown"}, "unknown": {"clear": "failed"}, "failed": {"start": "running"}, "ok": {"start": "running"}}


def run_states(events: DataFrame, key: str, order: list[str], op: str, allowed: dict[str, dict[str, str]] = RUNS, dead_after: str | None = None) -> DataFrame:
    """(key, accepted, refused, state) after each batch that has events of the key: operations in order through a state
    machine that the stream keeps for each key.  An operation that the state doesn't allow is counted and changes nothing.
    dead_after: a key in state running that is silent for so long (event time, by the watermark) becomes unknown."""
    kind = events.schema[key].dataType.simpleString()

    def fold(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, accepted, refused = held.get if held.exists else ("", 0, 0)
        if held.hasTimedOut:
            state = "unknown" if state == "running" else state
        else:
            for name in pd.concat(list(parts)).sort_values(order)[op]:
                after = allowed.get(state, {}).get(name)
                state, accepted, refused = (state, accepted, refused + 1) if after is None else (after, accepted + 1, refused)
        held.update((state, accepted, refused))
        if dead_after and not held.hasTimedOut:
            held.setTimeoutTimestamp(held.getCurrentWatermarkMs() + int(pd.Timedelta(dead_after).total_seconds() * 1000))
        yield pd.DataFrame([(k[0], accepted, refused, state)], columns=[key, "accepted", "refused", "state"])

    timeout = GroupStateTimeout.EventTimeTimeout if dead_after else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, accepted long, refused long, state string", "state string, accepted long, refused long", "update", timeout)
