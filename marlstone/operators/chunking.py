"""Chunk tables: paragraph chunks with ordinals and ids, spreadsheet row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import chunk_text, relative_time, select_sentences, sentences, structured_token_estimate, token_estimate
from marlstone.session import table


def chunks(docs: DataFrame, key: str = "doc_id", most: int = 900, boundary: str = "\\n\\s*\\n", joint: str = "\n\n") -> DataFrame:
    """SC-01, SRC-38, WN-02: one row for each chunk: key, ordinal, chunk_id ``{key}_{ordinal}``, text. No shuffle."""
    found = docs.select(key, F.posexplode(chunk_text(F.col("text"), most, boundary, joint)).alias("ordinal", "chunk"))
    return found.select(key, "ordinal", F.concat_ws("_", F.col(key).cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), "chunk")


def row_groups(rows: DataFrame, sheet: str, order: str, cells: list[str], size: int = 12) -> DataFrame:
    """SRC-13, SRC-14: rows of a sheet in groups of ``size``: heading ``Rows a-b of n``, blank cells left out. Numbering is by
    sheet; a sheet is one workbook page."""
    numbered = rows.withColumn("row_no", F.row_number().over(Window.partitionBy(sheet).orderBy(order))).withColumn("n", F.count("*").over(Window.partitionBy(sheet)))
    line = F.concat_ws(" | ", *[F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cells])
    group = F.floor((F.col("row_no") - 1) / size)
    each = numbered.select(sheet, group.alias("row_group"), "row_no", "n", line.alias("line"))
    made = each.groupBy(sheet, "row_group").agg(
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("lines")
    )
    head = F.concat(F.lit("Rows "), F.col("first_row"), F.lit("-"), F.col("last_row"), F.lit(" of "), F.col("n"))
    return made.select(sheet, "row_group", head.alias("heading"), F.array_join("lines.line", "\n").alias("body"))


def _estimates(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", token_estimate(t).alias("tokens"), structured_token_estimate(t).alias("structured_tokens"), F.size(sentences(t)).alias("n_sentences"))


def _ages(s: SparkSession, d: str) -> DataFrame:
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(s, d, "events").select("event_id", relative_time(age).alias("age"))


QUERIES = {
    "sc01_chunks": lambda s, d: chunks(table(s, d, "documents"), most=900, boundary="\\n", joint="\n"),
    "src14_row_groups": lambda s, d: row_groups(table(s, d, "part"), "p_brand", "p_partkey", ["p_name", "p_size"]),
    "sc02_sc70_token_estimates": _estimates,
    "sc16_relative_time": _ages,
    "tk07_sentence_selection": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(select_sentences(F.col("text"), 0.3, ("the",)), ". ").alias("kept")),
}
ORACLE_SQL = {
    "src14_row_groups": """WITH n AS (SELECT p_brand, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
 SELECT p_brand, (row_no - 1) // 12 AS row_group, 'Rows ' || min(row_no) || '-' || max(row_no) || ' of ' || min(n) AS heading, string_agg('p_name: ' || p_name || ' | p_size: ' || p_size, chr(10) ORDER BY row_no) AS body FROM n GROUP BY 1, 2""",
    "sc02_sc70_token_estimates": """WITH t AS (SELECT doc_id, text, CAST(floor(length(text) * 0.7::DOUBLE) AS INT) AS n FROM documents),
 u AS (SELECT *, CASE WHEN regexp_matches(text, '[|{]') THEN CAST(floor(n * 0.8::DOUBLE) AS INT) ELSE n END AS m FROM t)
 SELECT doc_id, greatest(1, CAST(floor(length(text) / 4) AS INT)) AS tokens, greatest(1, CASE WHEN regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+|[0-9]{3,}|[$]') THEN CAST(floor(m * 1.1::DOUBLE) AS INT) ELSE m END) AS structured_tokens,
 len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS n_sentences FROM u""",
    "sc16_relative_time": """WITH a AS (SELECT event_id, epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS s FROM events), b AS (SELECT event_id, s, CASE WHEN s < 60 THEN 0 WHEN s < 3600 THEN floor(s / 60) WHEN s < 86400 THEN floor(s / 3600) WHEN s < 2592000 THEN floor(s / 86400) ELSE floor(s / 2592000) END::BIGINT AS n, CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 2592000 THEN 'day' ELSE 'month' END AS u FROM a)
 SELECT event_id, CASE WHEN s < 60 THEN 'just now' ELSE n || ' ' || u || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM b""",
}
