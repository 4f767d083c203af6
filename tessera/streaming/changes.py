"""The stream of file events: debounce, renames, and applying changes batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEBOUNCE = "2 seconds"


def split_renames(events: DataFrame) -> DataFrame:
    """events (path, old_path, type, ts): a rename is a delete of the old path and a create of the new."""
    one = F.struct(F.col("path"), F.when(F.col("type") == "rename", "create").otherwise(F.col("type")).alias("type"))
    two = F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("type"))
    both = F.when((F.col("type") == "rename") & F.col("old_path").isNotNull(), F.array(two, one)).otherwise(F.array(one))
    return events.select("ts", F.explode(both).alias("e")).select("e.path", "e.type", "ts")


def debounce(events: DataFrame, gap: str = DEBOUNCE, watermark: str | None = "10 seconds") -> DataFrame:
    """(path, type, started, events): events of a path less than the gap apart are one change, of the last event's type. Works on a stream (with
    a watermark: later events are dropped) and on a table (without)."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming and watermark else events
    sessions = rows.groupBy("path", F.session_window("ts", gap).alias("w"))
    out = sessions.agg(F.max_by("type", F.struct("ts", "type")).alias("type"), F.count(F.lit(1)).alias("events"))
    return out.select("path", "type", F.col("w.start").alias("started"), "events")


def to_action(changes: DataFrame) -> DataFrame:
    """A delete removes; all else indexes anew."""
    return changes.withColumn("action", F.when(F.col("type") == "delete", "remove").otherwise("index"))


def apply_changes(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run a function on each micro-batch of changes; restarted from the checkpoint, a batch comes again with its number, so that the function can
    tell what it has already written."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_events(spark, folder: str, schema: str) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(schema).parquet(folder)
