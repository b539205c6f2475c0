"""The reference's roles on the driver's tables: query log, citations, chunks, corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table

LOG_SQL = """SELECT event_id AS query_id, user_id, CAST(ts AS TIMESTAMP) AS created_at, event_type = 'error' AS used_fallback,
 CAST((event_id * 37) % 10000 AS DOUBLE) / 10000 AS retrieval_confidence, CAST(floor(value) AS INT) AS processing_time_ms,
 CAST(json_extract_string(props, '$.k') AS INT) AS total_tokens FROM events"""
CITATION_SQL = """SELECT q.event_id AS query_id, (q.event_id * 7 + r.rank * 13) % 200 AS document_id, r.rank AS citation_rank,
 round(0.95 - 0.1 * r.rank - CAST(q.event_id % 7 AS DOUBLE) / 100, 4) AS relevance_score
 FROM events q CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS rank) r"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fact_query``: one row for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("query_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_type") == "error").alias("used_fallback"),
        ((F.col("event_id") * 37) % 10000 / 10000).alias("retrieval_confidence"),
        F.floor("value").cast("int").alias("processing_time_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("total_tokens"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bridge_query_citation``: four ranked citations for each query."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("rank"))
    return e.select(
        F.col("event_id").alias("query_id"),
        ((F.col("event_id") * 7 + F.col("rank") * 13) % 200).alias("document_id"),
        F.col("rank").alias("citation_rank"),
        F.round(F.lit(0.95) - 0.1 * F.col("rank") - (F.col("event_id") % 7) / 100, 4).alias("relevance_score"),
    )
