"""Append-only events and file snapshots as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.stores import TIMELINE


def timeline(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """The JSON-lines timeline as a stream; blank lines come out null and are left out."""
    return spark.readStream.schema(TIMELINE).option("maxFilesPerTrigger", files_per_trigger).json(path).filter("type is not null")


def copy_new(df: DataFrame, path: str, checkpoint: str):
    """Writes what is there and stops; run again, it takes what is new."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def event_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events by window and kind; rows later than ``late`` are dropped by the
    watermark, so the state stays bounded."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", window, slide) if slide else F.window("_t", window)
    return t.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(user, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def file_changes(snapshots: DataFrame) -> DataFrame:
    """(path, hash, change) of a stream of (path, hash, seq): state holds one
    hash a path; an empty hash is a deletion and is told once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for h in rows["hash"]:
            h = h or ""
            if old is None and h:
                out.append((key[0], h, "added"))
            elif old is not None and h != old:
                out.append((key[0], h, "deleted" if not h else "changed" if old else "added"))
            old = h if h or old is not None else None
        if old is not None:
            state.update((old,))
        yield pd.DataFrame(out, columns=["path", "hash", "change"])

    return snapshots.groupBy("path").applyInPandasWithState(step, "path string, hash string, change string", "hash string", "append", GroupStateTimeout.NoTimeout)
