"""Rollups of runs, contexts, workbooks and cells; coercions of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.samples import ASKED_SQL, asked, pick, pick_sql
from marlstone.session import table

# What a date looks like.
DATE_LIKE = (r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", r"\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")


def batch_totals(runs: DataFrame, by: str) -> DataFrame:
    """AG-23, AG-35: files, chunks, mean, least and greatest quality, share of successes, for each ``by``."""
    return runs.groupBy(by).agg(
        F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.avg("quality").alias("mean_quality"), F.min("quality").alias("least"), F.max("quality").alias("greatest"), F.avg(F.col("ok").cast("int")).alias("success_rate")
    )


def entity_union(contexts: DataFrame, by: str, entities: str, score: str) -> DataFrame:
    """AG-28, AG-34, SO-05: all entities of a ``by`` once each, sorted, and how many contexts score above 0.8. Entities are made
    distinct before they are gathered, so what is gathered is the result."""
    each = contexts.select(by, F.explode(entities).alias("e")).distinct()
    union = each.groupBy(by).agg(F.array_sort(F.collect_set("e")).alias("entities"))
    good = contexts.groupBy(by).agg(F.count_if(F.col(score) > 0.8).alias("good"))
    return good.join(union, by, "left")


def integration_totals(results: DataFrame) -> DataFrame:
    """AG-18: relationships, insights and actions in all, and how many departments and seasons there are."""
    return results.agg(
        F.sum(F.size("others")).alias("relationships"), F.sum(F.size("insights")).alias("insights"), F.sum(F.size("actions")).alias("actions"), F.count_distinct("department").alias("departments"), F.count_distinct("season").alias("seasons")
    )


def is_number(value: Column) -> Column:
    """PF-21: a number once currency signs, commas and blanks are gone."""
    return F.regexp_replace(value, r"[৳$,\s]", "").try_cast("double").isNotNull()


def is_date_like(value: Column) -> Column:
    """PF-21."""
    return F.exists(F.array(*[F.lower(value).rlike(p) for p in DATE_LIKE]), lambda x: x)


def column_kinds(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """SC-96: columns by their cells: numeric above 0.7 numbers, date above 0.5 dates, else text; empty without cells."""
    v = F.col(value)
    n, numbers, dates = F.count(v), F.count_if(is_number(v)), F.count_if(is_date_like(v))
    kind = F.when(n == 0, "empty").when(numbers > n * 0.7, "numeric_data").when(dates > n * 0.5, "date_time").otherwise("text_data")
    return cells.groupBy(*by).agg(kind.alias("kind"))


def used_columns(cells: DataFrame, by: list[str], column: str, value: str = "value") -> DataFrame:
    """PF-20: columns with any value."""
    return cells.filter(F.col(value).isNotNull() & (F.trim(value) != "")).select(*by, column).distinct()


def sheet_confidence(sheets: DataFrame) -> DataFrame:
    """AG-31: (0.5 + 0.3 of the recognised columns + 0.02 for each entity, at most 0.2) times the share of filled cells."""
    raw = 0.5 + 0.3 * (F.col("recognised") / F.col("columns")) + F.least(F.lit(0.2), 0.02 * F.col("entities"))
    return sheets.withColumn("confidence", raw * (F.col("filled") / F.col("cells")))


def json_strings(value: Column) -> Column:
    """SC-113: a JSON array of strings; null and what is none become empty."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def script(text: Column) -> Column:
    """SC-103: Bengali where more than a tenth of the characters are, else Latin letters, else unknown."""
    bengali = F.regexp_count(text, F.lit("[ঀ-৿]"))
    return F.when(bengali * 10 > F.length(text), "bengali").when(text.rlike("[A-Za-z]"), "english").otherwise("unknown")


def corpus_summary(chunks: DataFrame, by: str) -> DataFrame:
    """AG-09, AG-10: documents, chunks, newest, flags and mean relevance for each ``by``."""
    return chunks.groupBy(by).agg(
        F.count_distinct("document").alias("documents"), F.count("*").alias("chunks"), F.max("at").alias("newest"), F.count_if("flag").alias("flagged"), F.avg("relevance").alias("relevance")
    )


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_type", (F.col("event_id") % 7).alias("chunks"), (F.col("event_id") * 29 % 101).alias("quality"), (F.col("event_id") % 5 > 0).alias("ok"))


def _contexts(s: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) > 14)
    return table(s, d, "documents").select(F.col("lang").alias("workbook"), words.alias("entities"), (F.col("n_chars") % 101 / 100).alias("score"))


def _results(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    some = lambda n: F.slice(F.array(*[F.lit(x) for x in "abcdef"]), F.lit(1), (k % n).cast("int"))
    return table(s, d, "events").select(some(4).alias("others"), some(3).alias("insights"), some(5).alias("actions"), "event_type", (k % 6).alias("department"), (k % 4).alias("season"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    cells = {"key": F.col("o_orderkey").cast("string"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "status": F.col("o_orderstatus"), "none": F.lit(None).cast("string"), "mixed": F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$ "), F.col("o_orderkey"))).otherwise("n/a")}
    return o.select((F.col("o_custkey") % 3).alias("sheet"), F.explode(F.array(*[F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in cells.items()])).alias("c")).select("sheet", "c.column", "c.value")


def _sheets(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", (k % 5 + 5).alias("columns"), (k % 5).alias("recognised"), (k % 20).alias("entities"), (k % 9 + 11).alias("cells"), (k % 9 + 2).alias("filled"))


_JSON = ('["a", "b"]', "", "not json", '{"a": 1}', "[]", '["x"]')
QUERIES = {
    "ag23_batch_totals": lambda s, d: batch_totals(_runs(s, d), "event_type").select("event_type", "files", "chunks", F.round("mean_quality", 6).alias("mean_quality"), "least", "greatest", F.round("success_rate", 6).alias("success_rate")),
    "ag28_entity_union": lambda s, d: entity_union(_contexts(s, d), "workbook", "entities", "score").select("workbook", "good", F.array_join("entities", ",").alias("entities")),
    "ag18_integration_totals": lambda s, d: integration_totals(_results(s, d)),
    "sc96_column_kinds": lambda s, d: column_kinds(_cells(s, d), ["sheet", "column"]),
    "pf20_used_columns": lambda s, d: used_columns(_cells(s, d), ["sheet"], "column"),
    "ag31_sheet_confidence": lambda s, d: sheet_confidence(_sheets(s, d)).select("c_custkey", F.round("confidence", 6).alias("confidence")),
    "sc113_json_strings": lambda s, d: table(s, d, "events").select("event_id", F.array_join(json_strings(pick(_JSON, F.col("event_id"))), ",").alias("values")),
    "sc103_script": lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("event_id"), F.col("html").alias("t")).unionByName(asked(s, d).select("event_id", F.col("question").alias("t"))).select("event_id", script(F.col("t")).alias("script")),
    "ag09_summary_full": lambda s, d: corpus_summary(table(s, d, "documents").select("source", F.col("doc_id").alias("document"), F.col("n_chars").alias("at"), (F.col("lang") == "en").alias("flag"), (F.col("doc_id") % 10).alias("relevance")), "source").select("source", "documents", "chunks", "newest", "flagged", F.round("relevance", 6).alias("relevance")),
}
_CELLS = "(SELECT o_custkey % 3 AS sheet, unnest(['key', 'date', 'status', 'none', 'mixed']) AS \"column\", unnest([CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus, NULL, CASE WHEN o_orderkey % 2 = 0 THEN '$ ' || o_orderkey ELSE 'n/a' END]) AS value FROM orders)"
ORACLE_SQL = {
    "ag23_batch_totals": "SELECT event_type, count(*) AS files, CAST(sum(event_id % 7) AS BIGINT) AS chunks, round(avg(event_id * 29 % 101), 6) AS mean_quality, min(event_id * 29 % 101) AS least, max(event_id * 29 % 101) AS greatest, round(avg(CAST(event_id % 5 > 0 AS INT)), 6) AS success_rate FROM events GROUP BY 1",
    "ag28_entity_union": "WITH c AS (SELECT lang AS workbook, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) > 14) AS es, n_chars % 101 / 100::DOUBLE AS score FROM documents) SELECT workbook, count(*) FILTER (score > 0.8) AS good, array_to_string(list_sort(list_distinct(flatten(list(es)))), ',') AS entities FROM c GROUP BY 1",
    "ag18_integration_totals": "SELECT CAST(sum(event_id % 4) AS BIGINT) AS relationships, CAST(sum(event_id % 3) AS BIGINT) AS insights, CAST(sum(event_id % 5) AS BIGINT) AS actions, count(DISTINCT event_id % 6) AS departments, count(DISTINCT event_id % 4) AS seasons FROM events",
    "sc96_column_kinds": f"SELECT sheet, \"column\", CASE WHEN count(value) = 0 THEN 'empty' WHEN count(*) FILTER (try_cast(regexp_replace(value, '[৳$,\\s]', '', 'g') AS DOUBLE) IS NOT NULL) > count(value) * 0.7 THEN 'numeric_data' WHEN count(*) FILTER (" + " OR ".join(f"regexp_matches(lower(value), '{p}')" for p in DATE_LIKE) + f") > count(value) * 0.5 THEN 'date_time' ELSE 'text_data' END AS kind FROM {_CELLS} GROUP BY 1, 2",
    "pf20_used_columns": f"SELECT DISTINCT sheet, \"column\" FROM {_CELLS} WHERE trim(value) <> ''",
    "ag31_sheet_confidence": "SELECT c_custkey, round((0.5::DOUBLE + 0.3::DOUBLE * (c_custkey % 5 / (c_custkey % 5 + 5)::DOUBLE) + least(0.2::DOUBLE, 0.02::DOUBLE * (c_custkey % 20))) * ((c_custkey % 9 + 2) / (c_custkey % 9 + 11)::DOUBLE), 6) AS confidence FROM customer",
    "sc113_json_strings": f"SELECT event_id, CASE {pick_sql(_JSON, 'event_id')} WHEN '[\"a\", \"b\"]' THEN 'a,b' WHEN '[\"x\"]' THEN 'x' ELSE '' END AS values FROM events",
    "sc103_script": f"SELECT event_id, CASE WHEN len(regexp_extract_all(t, '[ঀ-৿]')) * 10 > length(t) THEN 'bengali' WHEN regexp_matches(t, '[A-Za-z]') THEN 'english' ELSE 'unknown' END AS script FROM (SELECT page_id AS event_id, html AS t FROM pages UNION ALL SELECT event_id, question FROM ({ASKED_SQL}))",
    "ag09_summary_full": "SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, max(n_chars) AS newest, count(*) FILTER (lang = 'en') AS flagged, round(avg(doc_id % 10), 6) AS relevance FROM documents GROUP BY 1",
}
