"""Streaming queries over the event table, run on what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.working import shared_folder
from marlstone.streaming.jobs import daily_counts, rate_limited, read_log, run_updates, running_totals


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a file stream takes folders or patterns; the pattern matches the one file or folder
    return read_log(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema)


def _totals(s: SparkSession, d: str) -> DataFrame:
    log = _log(s, d).withColumn("tokens", F.floor("value").cast("long"))
    return run_updates(running_totals(log, "event_type", {"tokens_saved": "tokens"}), shared_folder(s), ["event_type", "day"])


QUERIES = {
    "st02_daily_stream": lambda s, d: run_updates(daily_counts(_log(s, d)), shared_folder(s), ["day"]),
    "st05_running_totals": _totals,
    "st06_rate_limits": lambda s, d: run_updates(rate_limited(_log(s, d), 1, "event_type"), shared_folder(s), ["event_type", "minute"]),
}
ORACLE_SQL = {
    "st02_daily_stream": "SELECT CAST(ts AS DATE) AS day, count(*) AS queries, count(*) FILTER (event_type = 'error') AS fallbacks FROM events GROUP BY 1",
    "st05_running_totals": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens_saved FROM events GROUP BY 1, 2",
    "st06_rate_limits": "SELECT event_type, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1",
}
