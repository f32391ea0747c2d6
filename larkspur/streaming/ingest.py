"""Sessions as they arrive: an extension of resumption to a file stream.

The stream's checkpoint takes the place of the set of finished results: it knows the batches that
are done, and, behind ``first_arrivals``, the sessions. So a restart scores each session once, and
a session that arrives again is not scored again. Scoring itself is the batch operator on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import free


def session_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files below a folder as a stream of sessions, with their raw text."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("s"), F.col("value").alias("raw")).select("s.*", "raw")


def score_stream(sessions: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and append it below ``out``, in a folder named by the batch's
    number: a batch that runs again after a failure replaces its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sessions.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(sessions: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first arrival of each key over the life of the stream's checkpoint; a missing key part
    is an empty one. Keys are held in the state store, a row each, by hash of the key. With an
    ``event_time`` they are given up once later than ``late``, which bounds the state and lets a
    session that comes again after that pass."""
    names = free(sessions, *[f"_k{i}" for i in range(len(keys))])
    rows = sessions.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, keys)})
    if event_time is not None:
        return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(names).drop(*names)
    return rows.dropDuplicates(names).drop(*names)


def tier_counts(results: DataFrame, event_time: str = "scored_at", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Tiers by event-time window; rows later than ``late`` no longer change a window."""
    return results.withWatermark(event_time, late).groupBy(F.window(event_time, window), "tier").agg(F.count("*").alias("n"))
