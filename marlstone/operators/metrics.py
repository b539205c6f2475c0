"""Operational metrics over the query log: summary, percentile, daily series, citation rollups, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import table
from marlstone.sources.tables import CITATION_SQL, LOG_SQL, citations, query_log


def summary(log: DataFrame) -> DataFrame:
    """AG-01: averages ignore nulls, sums count them as 0, an empty log has rate 0."""
    return log.agg(
        F.count("*").alias("total_queries"),
        F.bround(F.avg("processing_time_ms"), 1).alias("avg_latency_ms"),
        F.coalesce(F.bround(F.avg(F.col("used_fallback").cast("int")), 4), F.lit(0.0)).alias("fallback_rate"),
        F.bround(F.avg("retrieval_confidence"), 4).alias("avg_confidence"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )


def p95(log: DataFrame, column: str = "processing_time_ms") -> DataFrame:
    """AG-02: the value at place round-half-even(0.95 * (n - 1)) of the sorted values. The place is found from the counts of
    distinct values, so no list of all values is ever gathered."""
    values = log.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    # latencies are whole milliseconds: one row for each distinct value enters the ordered sum
    upto = values.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum("c").over(Window.partitionBy())
    place = F.bround(F.lit(0.95) * (n - 1)).cast("long")
    return upto.withColumn("place", place).filter(F.col("upto") > F.col("place")).agg(F.min("v").alias("p95_latency_ms"))


def daily(log: DataFrame) -> DataFrame:
    """AG-03: one row for each UTC day that has queries."""
    return log.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("queries"),
        F.sum(F.col("used_fallback").cast("int")).alias("fallbacks"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.bround(F.avg("processing_time_ms"), 1).alias("avg_latency_ms"),
    )


def top_cited(bridge: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """AG-04, JN-06: citations for each document with its department, greatest first, smallest id on ties."""
    counts = bridge.groupBy("document_id").agg(F.count("*").alias("citations"))
    found = counts.join(docs, counts["document_id"] == docs["doc_id"], "left")
    return found.select("document_id", F.coalesce("source", F.lit("Unknown")).alias("department"), "citations").orderBy(F.desc("citations"), "document_id").limit(k)


def cited_departments(bridge: DataFrame, docs: DataFrame) -> DataFrame:
    """AG-05: citations for each department; counted before the join, so the join moves one row for each document."""
    counts = bridge.groupBy("document_id").agg(F.count("*").alias("n"))
    found = counts.join(docs, counts["document_id"] == docs["doc_id"], "left")
    return found.groupBy(F.coalesce("source", F.lit("Unknown")).alias("department")).agg(F.sum("n").alias("citations"))


def recent(log: DataFrame, k: int = 50) -> DataFrame:
    """TK-06."""
    return log.select("query_id", "user_id", "created_at").orderBy(F.desc("created_at"), F.desc("query_id")).limit(k)


def windowed(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """PF-10 without the row cap: queries of the last ``days`` before ``as_of``."""
    return log.filter(F.col("created_at") >= F.expr(f"timestamp'{as_of}' - interval {days} days"))


def visible_citations(bridge: DataFrame, log: DataFrame, user_id: int) -> DataFrame:
    """JN-07, PF-09: citations of the queries that a user owns."""
    return bridge.join(log.filter(F.col("user_id") == user_id), "query_id", "left_semi")


def latest_rating(ratings: DataFrame, key: str, at: str) -> DataFrame:
    """WN-10, SRC-22: the last write of a key wins. ``max_by`` keeps one row for each key on the map side."""
    return ratings.groupBy(key).agg(F.max_by("rating", at).alias("rating"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source")


def _score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11."""
    s = F.col("relevance_score")
    out = citations(spark, sf_dir).agg(
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.round(F.avg(s), 6).alias("mean_score"),
        F.round(F.stddev_pop(s), 6).alias("std_score"),
        F.round(F.max(s) - F.min(s), 6).alias("score_range"),
        F.count_if(s > 0.8).alias("high"),
        F.count_if((s >= 0.5) & (s <= 0.8)).alias("medium"),
        F.count_if(s < 0.5).alias("low"),
    )
    return out


def _gate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-07, AG-08: confidence and source diversity of each query's citations."""
    c = citations(spark, sf_dir).join(_docs(spark, sf_dir), F.col("document_id") == F.col("doc_id"), "left")
    return c.groupBy("query_id").agg(
        F.coalesce(F.max("relevance_score"), F.lit(0.0)).alias("confidence"),
        F.bround(F.count_distinct(F.coalesce("source", F.lit(""))) / F.count("*"), 2).alias("diversity"),
    )


QUERIES = {
    "ag01_log_summary": lambda s, d: summary(query_log(s, d)),
    "ag02_p95_latency": lambda s, d: p95(query_log(s, d)),
    "ag03_daily_series": lambda s, d: daily(query_log(s, d)),
    "ag04_top_cited": lambda s, d: top_cited(citations(s, d), _docs(s, d)),
    "ag05_cited_departments": lambda s, d: cited_departments(citations(s, d), _docs(s, d)),
    "ag06_freshness": lambda s, d: table(s, d, "documents").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("documents"), F.max("doc_id").alias("newest")),
    "ag07_08_confidence_diversity": lambda s, d: _gate_inputs(s, d),
    "ag09_corpus_summary": lambda s, d: table(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.count_if(F.col("n_chars") > 1000).alias("long_chunks"), F.round(F.avg("n_chars"), 4).alias("avg_chars")),
    "ag11_score_distribution": _score_distribution,
    "tk06_recent": lambda s, d: recent(query_log(s, d)),
    "pf10_window": lambda s, d: windowed(query_log(s, d), "2024-01-30 00:00:00", 7).select("query_id", "user_id"),
    "jn05_windowed_citations": lambda s, d: citations(s, d).join(windowed(query_log(s, d), "2024-01-30 00:00:00", 3), "query_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n")),
    "jn07_visible_citations": lambda s, d: visible_citations(citations(s, d), query_log(s, d), 7),
    "wn10_latest_rating": lambda s, d: latest_rating(query_log(s, d).select("user_id", F.col("total_tokens").alias("rating"), F.col("query_id").alias("at")), "user_id", "at"),
}
_C = f"WITH c AS ({CITATION_SQL}), q AS ({LOG_SQL})"
ORACLE_SQL = {
    "ag01_log_summary": f"SELECT count(*) AS total_queries, round_even(avg(processing_time_ms), 1) AS avg_latency_ms, round_even(avg(CAST(used_fallback AS INT)), 4) AS fallback_rate, round_even(avg(retrieval_confidence), 4) AS avg_confidence, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM ({LOG_SQL})",
    "ag02_p95_latency": f"SELECT list_sort(list(processing_time_ms))[CAST(round_even(0.95::DOUBLE * (count(*) - 1), 0) AS INT) + 1] AS p95_latency_ms FROM ({LOG_SQL})",
    "ag03_daily_series": f"SELECT CAST(created_at AS DATE) AS day, count(*) AS queries, CAST(sum(CAST(used_fallback AS INT)) AS BIGINT) AS fallbacks, CAST(sum(total_tokens) AS BIGINT) AS tokens, round_even(avg(processing_time_ms), 1) AS avg_latency_ms FROM ({LOG_SQL}) GROUP BY 1",
    "ag04_top_cited": f"{_C} SELECT document_id, coalesce(source, 'Unknown') AS department, count(*) AS citations FROM c LEFT JOIN documents ON doc_id = document_id GROUP BY 1, 2 ORDER BY citations DESC, document_id LIMIT 10",
    "ag05_cited_departments": f"{_C} SELECT coalesce(source, 'Unknown') AS department, count(*) AS citations FROM c LEFT JOIN documents ON doc_id = document_id GROUP BY 1",
    "ag06_freshness": "SELECT count(DISTINCT source) AS sources, count(*) AS documents, max(doc_id) AS newest FROM documents",
    "ag07_08_confidence_diversity": f"{_C} SELECT query_id, max(relevance_score) AS confidence, round_even(count(DISTINCT coalesce(source, ''))::DOUBLE / count(*), 2) AS diversity FROM c LEFT JOIN documents ON doc_id = document_id GROUP BY 1",
    "ag09_corpus_summary": "SELECT source, lang, count(*) AS chunks, count(*) FILTER (n_chars > 1000) AS long_chunks, round(avg(n_chars), 4) AS avg_chars FROM documents GROUP BY 1, 2",
    "ag11_score_distribution": f"{_C} SELECT min(relevance_score) AS min_score, max(relevance_score) AS max_score, round(avg(relevance_score), 6) AS mean_score, round(stddev_pop(relevance_score), 6) AS std_score, round(max(relevance_score) - min(relevance_score), 6) AS score_range, count(*) FILTER (relevance_score > 0.8) AS high, count(*) FILTER (relevance_score BETWEEN 0.5 AND 0.8) AS medium, count(*) FILTER (relevance_score < 0.5) AS low FROM c",
    "tk06_recent": f"SELECT query_id, user_id, created_at FROM ({LOG_SQL}) ORDER BY created_at DESC, query_id DESC LIMIT 50",
    "pf10_window": f"SELECT query_id, user_id FROM ({LOG_SQL}) WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY",
    "jn05_windowed_citations": f"{_C} SELECT document_id, count(*) AS n FROM c WHERE query_id IN (SELECT query_id FROM q WHERE created_at >= TIMESTAMP '2024-01-27 00:00:00') GROUP BY 1",
    "jn07_visible_citations": f"{_C} SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM q WHERE q.query_id = c.query_id AND q.user_id = 7)",
    "wn10_latest_rating": f"SELECT user_id, arg_max(total_tokens, query_id) AS rating FROM ({LOG_SQL}) GROUP BY 1",
}
