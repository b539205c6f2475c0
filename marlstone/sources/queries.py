"""Source and sink operators as queries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table
from marlstone.sources.files import append_new, fold_manifest, snapshots_to_drop, upsert


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """Orders of odd keys arrive again with another status."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("v"))
    again = o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("v"))
    return upsert(o, again, ["o_orderkey"], "v").select("o_orderkey", "o_orderstatus")


def _append(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    return append_new(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "text").select("content_hash")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") < 5, "folder").when(F.col("p_size") < 10, "application/spreadsheet").otherwise("text/plain").alias("mime"),
        F.col("p_size").alias("size"),
        F.when(F.col("p_size") % 2 == 0, F.md5("p_type")).alias("md5"),
    )
    return fold_manifest(p).select("id", "checksum")


QUERIES = {
    "src19_upsert": _upsert,
    "src25_append_new": _append,
    "src30_manifest": _manifest,
    "src24_snapshots": lambda s, d: snapshots_to_drop(table(s, d, "nation").select(F.col("n_name").alias("name"))),
}
ORACLE_SQL = {
    "src19_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "src25_append_new": "SELECT DISTINCT md5(text) AS content_hash FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "src30_manifest": "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 2 = 0 THEN md5(p_type) ELSE md5(p_name || '_' || p_size || '_' || p_partkey) END AS checksum FROM part WHERE p_size >= 10",
    "src24_snapshots": "SELECT n_name AS name FROM nation ORDER BY n_name DESC OFFSET 5",
}
