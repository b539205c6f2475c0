"""Rule engines as queries: document typing, business context scores, facets, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import understanding as U
from marlstone.functions.understanding import category, department_of_type, document_type, normalise_currency, normalise_date, text_quality
from marlstone.plans.samples import ASKED_SQL, asked, cases_sql, text_sql
from marlstone.session import table


def season(month: Column) -> Column:
    """SC-55."""
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def age_multiplier(age_days: Column) -> Column:
    """SC-56, JN-22: by age 1.5, 1.2, 0.8, 0.5; older than a year 0, as the reference computes it."""
    return F.when(age_days <= 7, 1.5).when(age_days <= 30, 1.2).when(age_days <= 90, 0.8).when(age_days <= 365, 0.5).otherwise(0.0)


def impact(score: Column, alignment: Column, temporal: Column, strength: Column, multiplier: Column, relations: Column) -> Column:
    """SC-57: 0.5 + 0.3 score + 0.2 alignment + 0.2 temporal + min(0.3, m / 10 * s * 0.3) + min(0.2, 0.05 n), within 0 and 1."""
    raw = 0.5 + 0.3 * score + 0.2 * alignment + 0.2 * temporal + F.least(F.lit(0.3), multiplier / 10 * strength * 0.3) + F.least(F.lit(0.2), 0.05 * relations)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def relevance_class(value: Column) -> Column:
    """SC-58."""
    return F.when(value > 0.8, "critical").when(value > 0.6, "high").when(value > 0.4, "medium").otherwise("low")


def final_business_score(score: Column, impact_: Column, alignment: Column, temporal: Column, class_: Column) -> Column:
    """SC-59: 0.3 score + 0.25 impact + 0.2 alignment + 0.15 temporal + 0.1 class (1, 0.7, 0.5, 0.3)."""
    c = F.when(class_ == "critical", 1.0).when(class_ == "high", 0.7).when(class_ == "medium", 0.5).otherwise(0.3)
    return 0.3 * score + 0.25 * impact_ + 0.2 * alignment + 0.15 * temporal + 0.1 * c


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """AG-15, AG-24, AG-26, AG-27: counts of every facet value in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("Unknown")).alias("value")) for f in facets]))
    return rows.select(each.alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def top_terms(rows: DataFrame, terms: Column, k: int = 10) -> DataFrame:
    """AG-16, AG-25: most frequent values, smallest first on ties."""
    return rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def focus_areas(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """AG-17: the name of the greatest sum."""
    sums = rows.groupBy(by, name).agg(F.sum(value).alias("v"))
    return sums.groupBy(by).agg(F.max_by(name, F.struct("v", name)).alias("focus"))


def _context(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(
        "event_id",
        "event_type",
        (F.col("event_id") * 29 % 101 / 100).alias("score"),
        (F.col("event_id") * 7 % 11 / 10).alias("alignment"),
        F.datediff(F.lit("2024-02-05").cast("date"), F.to_date("ts")).alias("age"),
        F.month("ts").alias("month"),
        (F.col("event_id") % 6).alias("relations"),
    )


def _impact(s: SparkSession, d: str) -> DataFrame:
    c = _context(s, d).withColumn("multiplier", age_multiplier(F.col("age")))
    c = c.withColumn("impact", F.round(impact(F.col("score"), F.col("alignment"), F.lit(0.5), F.lit(0.8), F.col("multiplier"), F.col("relations")), 6))
    c = c.withColumn("class", relevance_class(F.col("impact")))
    return c.select("event_id", "impact", "class", season(F.col("month")).alias("season"), F.round(final_business_score(F.col("score"), F.col("impact"), F.col("alignment"), F.lit(0.5), F.col("class")), 9).alias("final"))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Every turn, document and order in words with its file."""
    return asked(s, d).select("event_id", F.col("question").alias("text"), "file")


def _types(s: SparkSession, d: str) -> DataFrame:
    name, folder = F.substring_index("file", "/", -1), F.substring_index("file", "/", 1)
    kind = document_type(name, F.col("text"))
    return _files(s, d).select("event_id", kind.alias("kind"), department_of_type(kind).alias("department"), category(name, F.col("text"), folder).alias("category"))


def _day(k, ts):
    return F.when(k % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(ts, "dd/MM/yyyy")).otherwise(F.lit("soon"))


QUERIES = {
    "sc57_business_impact": _impact,
    "sc98_document_type": _types,
    "sc90_currency": lambda s, d: _files(s, d).select("event_id", normalise_currency(F.col("text")).alias("c")).select("event_id", "c.amount", "c.currency"),
    "sc101_text_quality": lambda s, d: table(s, d, "documents").select("doc_id", text_quality(F.col("text")).alias("q")).select("doc_id", "q.score", "q.label"),
    "sc91_dates": lambda s, d: table(s, d, "events").select("event_id", normalise_date(_day(F.col("event_id"), F.col("ts"))).alias("day")),
    "ag15_facets": lambda s, d: facet_counts(table(s, d, "documents"), ["source", "lang"]),
    "ag16_top_terms": lambda s, d: top_terms(table(s, d, "documents"), F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 0)),
    "ag17_focus_areas": lambda s, d: focus_areas(table(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), "l_returnflag", "l_suppkey", "q"),
    "so02_union_edges": lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("k")).union(table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n")),
    "so06_set_operations": lambda s, d: table(s, d, "orders").filter("o_totalprice > 100000").select("o_custkey").intersect(table(s, d, "customer").filter("c_acctbal > 0").select("c_custkey")).exceptAll(table(s, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey")).distinct().withColumnRenamed("o_custkey", "k"),
}
_NAME = "lower(string_split(file, '/')[2])"
_FILES = f"(SELECT event_id, question AS text, file FROM ({ASKED_SQL}))"
_KIND = cases_sql(_NAME, U.TYPES_BY_NAME, cases_sql("lower(text)", U.TYPES_BY_CONTENT, "'unknown'"))
_FOLDER = cases_sql("lower(string_split(file, '/')[1])", {"lc": ("lc",), "invoice": ("invoice",)}, "'unknown'")
_COUNT = lambda p: f"len(regexp_extract_all(body, {text_sql(p)}))"
ORACLE_SQL = {
    "sc57_business_impact": """WITH c AS (SELECT event_id, event_id * 29 % 101 / 100::DOUBLE AS score, event_id * 7 % 11 / 10::DOUBLE AS alignment, date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') AS age, month(ts) AS m, event_id % 6 AS relations FROM events),
 i AS (SELECT *, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + 0.3::DOUBLE * score + 0.2::DOUBLE * alignment + 0.1::DOUBLE + least(0.3::DOUBLE, CASE WHEN age <= 7 THEN 1.5 WHEN age <= 30 THEN 1.2 WHEN age <= 90 THEN 0.8 WHEN age <= 365 THEN 0.5 ELSE 0 END::DOUBLE / 10 * 0.8::DOUBLE * 0.3::DOUBLE) + least(0.2::DOUBLE, 0.05::DOUBLE * relations))), 6) AS impact FROM c),
 k AS (SELECT *, CASE WHEN impact > 0.8 THEN 'critical' WHEN impact > 0.6 THEN 'high' WHEN impact > 0.4 THEN 'medium' ELSE 'low' END AS class FROM i)
 SELECT event_id, impact, class, CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m IN (3, 4, 5) THEN 'spring' WHEN m IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, round(0.3::DOUBLE * score + 0.25::DOUBLE * impact + 0.2::DOUBLE * alignment + 0.075::DOUBLE + 0.1::DOUBLE * CASE class WHEN 'critical' THEN 1 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.5 ELSE 0.3 END::DOUBLE, 9) AS final FROM k""",
    "sc98_document_type": f"SELECT event_id, kind, CASE {' '.join(f"WHEN kind IN ({', '.join(map(text_sql, v))}) THEN {text_sql(k)}" for k, v in U.DEPARTMENTS_BY_TYPE.items())} ELSE 'commercial' END AS department, {cases_sql(_NAME, U.CATEGORIES, cases_sql('lower(text)', U.CATEGORIES, _FOLDER))} AS category FROM (SELECT *, {_KIND} AS kind FROM {_FILES})",
    "sc90_currency": f"""SELECT event_id, replace(coalesce(nullif(regexp_extract(text, '([0-9][0-9,]*(?:[.][0-9]+)?) ?(USD|EUR|GBP|BDT)', 1), ''), nullif(regexp_extract(text, '(USD|EUR|GBP|BDT) ?([0-9][0-9,]*(?:[.][0-9]+)?)', 2), ''), nullif(regexp_extract(text, '[$]([0-9][0-9,]*(?:[.][0-9]+)?)', 1), '')), ',', '')::DOUBLE AS amount,
 CASE WHEN regexp_matches(text, '[0-9] ?(USD|EUR|GBP|BDT)') THEN regexp_extract(text, '([0-9][0-9,]*(?:[.][0-9]+)?) ?(USD|EUR|GBP|BDT)', 2) WHEN regexp_matches(text, '(USD|EUR|GBP|BDT) ?[0-9]') THEN regexp_extract(text, '(USD|EUR|GBP|BDT) ?([0-9])', 1) WHEN regexp_matches(text, '[$][0-9]') THEN 'USD' END AS currency FROM {_FILES}""",
    "sc101_text_quality": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), u AS (SELECT *, string_split_regex(body, '[.!?]+') AS parts FROM t),
 v AS (SELECT doc_id, CASE WHEN body = '' THEN 0 ELSE greatest(0, 10 - CASE WHEN length(body) < 50 THEN 3 ELSE 0 END - CASE WHEN CAST({_COUNT(U.WORDS)} > 5 AS INT) + CAST({_COUNT(U.NUMBERS)} > 5 AS INT) + CAST({_COUNT(U.MARKS)} > 5 AS INT) < 2 THEN 2 ELSE 0 END
  - CASE WHEN {' OR '.join(f"{_COUNT(p)} * 20 > length(body)" for p in U.ARTEFACTS)} THEN 3 ELSE 0 END - CASE WHEN {_COUNT('[a-zA-Z]')} * 2 < length(body) THEN 2 ELSE 0 END
  - CASE WHEN len(list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10 AND contains(x, ' '))) * 2 < len(parts) THEN 2 ELSE 0 END) END AS s FROM u)
 SELECT doc_id, s / 10::DOUBLE AS score, CASE WHEN s >= 8 THEN 'excellent' WHEN s >= 6 THEN 'good' WHEN s >= 4 THEN 'fair' ELSE 'poor' END AS label FROM v""",
    "sc91_dates": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END AS day FROM events",
    "ag15_facets": "SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2",
    "ag16_top_terms": "SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 0)) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 10",
    "ag17_focus_areas": "WITH s AS (SELECT l_returnflag, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, arg_max(l_suppkey, (v, l_suppkey)) AS focus FROM s GROUP BY 1",
    "so02_union_edges": "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1",
    "so06_set_operations": "(SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
}
