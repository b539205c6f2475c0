"""Structured Streaming jobs over the query log: daily counters, ratings, rate limits, incremental ingest, thresholds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Each intent's own threshold and confidence to begin with; other intents have none.
STARTS = {"lookup_specific": (0.75, 0.9), "analysis_financial": (0.35, 0.85), "analysis_comparison": (0.45, 0.8), "analysis_trend": (0.25, 0.75)}
THRESHOLD_STATE = "intent string, threshold double, confidence double, seen long"


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """ST-02, SRC-06: the append-only log as a file stream; only files that were not seen are read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_counts(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """AG-03 as a stream: days with a watermark for late rows."""
    return (
        log.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", delay)
        .groupBy(F.window("at", "1 day").alias("w"))
        .agg(F.count("*").alias("queries"), F.count_if(F.col("event_type") == "error").alias("fallbacks"))
        .select(F.to_date("w.start").alias("day"), "queries", "fallbacks")
    )


def rate_limited(log: DataFrame, limit: int, key: str = "user_id", delay: str = "10 minutes") -> DataFrame:
    """ST-06: requests of a key in each minute beyond ``limit``."""
    per_minute = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).groupBy(key, F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("requests"))
    return per_minute.filter(F.col("requests") > limit).select(key, F.col("w.start").alias("minute"), "requests")


def _adapt(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    threshold, confidence, seen = state.get if state.exists else (*STARTS[key[0]], 0)
    for frame in frames:
        for q, relevance in frame.sort_values(["at", "query_id"])[["quality", "threshold_seen"]].itertuples(index=False):
            seen += 1
            if q > 0.8:
                threshold, confidence = 0.9 * threshold + 0.1 * relevance, min(0.95, confidence + 0.01)
            elif q < 0.5:
                threshold += 0.05 if relevance > threshold else -0.05
                confidence = max(0.5, confidence - 0.02)
    state.update((threshold, confidence, seen))
    yield pd.DataFrame({"intent": [key[0]], "threshold": [threshold], "confidence": [confidence], "seen": [seen]})


def adaptive_thresholds(feedback: DataFrame) -> DataFrame:
    """ST-04, SC-48: a threshold for each intent that follows feedback: rows of intent, at, query_id, quality, threshold_seen.
    Intents without a threshold of their own are left out."""
    return feedback.filter(F.col("intent").isin(*STARTS)).groupBy("intent").applyInPandasWithState(
        _adapt, THRESHOLD_STATE, "threshold double, confidence double, seen long", "update", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> str:
    """ST-03: processes what is there, writes Parquet below ``folder`` with its own checkpoint, and returns the path. A second
    run continues where the first ended."""
    path = f"{folder}/{name or uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").format("parquet").start(path)
    query.awaitTermination()
    return path


def run_updates(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Processes what is there in update mode and returns the newest row of each key, windows still open included. A batch
    that runs again overwrites what it wrote."""
    spark, path = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(write).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    rest = [c for c in stream.columns if c not in keys]
    newest = spark.read.option("basePath", path).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def running_totals(events: DataFrame, by: str, counters: dict[str, str], delay: str = "1 day") -> DataFrame:
    """ST-05: sums of counters for each ``by`` and day as they come in: contexts, tokens saved, documents bridged."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    sums = [F.sum(c).alias(name) for name, c in counters.items()]
    return at.groupBy(by, F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"), *sums).select(by, F.to_date("w.start").alias("day"), "n", *counters)


def ingest(stream: DataFrame, upsert, checkpoint: str) -> None:
    """SRC-19 on a stream: each batch goes through ``upsert(batch, batch_id)``; ids of batches make replays harmless."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(upsert).start().awaitTermination()
