"""Reranking: strategies by intent, business and temporal relevance, weighted scores, adaptive thresholds, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import table

# Strategy -> retrieve, return, threshold, weights (similarity, business, temporal, entity).
STRATEGIES = {
    "lookup": (20, 5, 0.7, (0.8, 0.2, 0.0, 0.0)),
    "financial": (100, 15, 0.3, (0.3, 0.4, 0.2, 0.1)),
    "comparison": (80, 12, 0.4, (0.35, 0.35, 0.1, 0.2)),
    "trend": (120, 20, 0.25, (0.25, 0.3, 0.35, 0.1)),
    "default": (50, 10, 0.5, (0.4, 0.3, 0.2, 0.1)),
}
# Similarity threshold by intent, and its change by complexity.
THRESHOLDS = {"lookup": 0.75, "financial": 0.35, "comparison": 0.45, "trend": 0.25}


def by_strategy(intent: Column, pick) -> Column:
    out = None
    for name, spec in STRATEGIES.items():
        if name != "default":
            out = F.when(intent == name, pick(spec)) if out is None else out.when(intent == name, pick(spec))
    return out.otherwise(pick(STRATEGIES["default"]))


def business_relevance(department: Column, financial: Column, entities: Column, complex_: Column, age_days: Column) -> Column:
    """SC-41."""
    return (
        F.when(department, 0.3).otherwise(0.0)
        + F.when(financial, 0.2).otherwise(0.0)
        + F.least(F.lit(0.3), 0.1 * entities)
        + F.when(complex_ & (age_days < 30), 0.1).otherwise(0.0)
    )


def temporal_relevance(age_days: Column, constrained: Column) -> Column:
    """SC-42: 0.5 without a constraint."""
    return F.when(~constrained, 0.5).when(age_days <= 30, 0.9).when(age_days <= 90, 0.7).when(age_days <= 365, 0.5).otherwise(0.3)


def final_score(intent: Column, similarity: Column, business: Column, temporal: Column, entity: Column) -> Column:
    """SC-44: weights of the strategy, 1 at most."""
    parts = (similarity, business, temporal, entity)
    total = sum((by_strategy(intent, lambda s: F.lit(s[3][k])) * p for k, p in enumerate(parts)), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def recency_boost(score: Column, age_days: Column, trend: Column) -> Column:
    """SC-46: times 1.2 within 30 days, 1.1 within 90, and 1.15 for trends between 30 and 365."""
    s = score * F.when(age_days <= 30, 1.2).when(age_days <= 90, 1.1).otherwise(1.0)
    return s * F.when(trend & (age_days > 30) & (age_days < 365), 1.15).otherwise(1.0)


def adaptive_threshold(intent: Column, complexity: Column, entities: Column) -> Column:
    """SC-47: by intent, a tenth up for simple and down for advanced queries, less for each entity, within 0.1 and 0.9."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), intent), F.lit(0.5))
    step = F.when(complexity == "simple", 0.1).when(complexity == "advanced", -0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), base + step - F.least(F.lit(0.1), 0.02 * entities)))


def diverse(rows: DataFrame, query: str, order: list[Column], key: list[str], k: int | Column) -> DataFrame:
    """WN-05: the first k div 2 of a query as they come, then only rows whose key was not seen, k in all (a column: one value a query)."""
    w = Window.partitionBy(query).orderBy(*order)
    placed = rows.withColumn("pos", F.row_number().over(w)).withColumn("seen", F.row_number().over(Window.partitionBy(query, *key).orderBy("pos")))
    passed = placed.filter((F.col("pos") <= F.floor(F.lit(k) / 2)) | (F.col("seen") == 1))
    return passed.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("pos"))).filter(F.col("rank") <= k).drop("pos", "seen")


def diversity_metrics(rows: DataFrame, query: str, kind: str, department: str, day: str) -> DataFrame:
    """AG-12."""
    n = F.count("*")
    types, departments = F.count_distinct(kind) / n, F.count_distinct(department) / n
    return rows.groupBy(query).agg(
        F.round(types, 6).alias("type_diversity"),
        F.round(departments, 6).alias("department_diversity"),
        F.datediff(F.max(day), F.min(day)).alias("day_spread"),
        F.round((types + departments) / 2, 6).alias("overall"),
    )


def search_quality(rows: DataFrame, query: str, score: str, kind: str) -> DataFrame:
    """AG-13, AG-14: 0.6 mean score + 0.2 diversity + 0.2 min(1, n / 10), 1 at most."""
    n = F.count("*")
    value = 0.6 * F.avg(score) + 0.2 * (F.count_distinct(kind) / n) + 0.2 * F.least(F.lit(1.0), n / 10)
    return rows.groupBy(query).agg(F.round(F.avg(score), 6).alias("avg_score"), F.round(F.least(F.lit(1.0), value), 6).alias("quality"))


def _results(s: SparkSession, d: str) -> DataFrame:
    """Results of queries: events as results, users as queries."""
    e = table(s, d, "events")
    intent = F.element_at(F.array(*[F.lit(x) for x in ("lookup", "financial", "comparison", "trend", "other")]), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("result_id"),
        "event_type",
        F.pmod("event_id", F.lit(6)).alias("department"),
        intent.alias("intent"),
        ((F.col("event_id") * 29 % 101) / 100).alias("similarity"),
        F.datediff(F.lit("2024-02-15").cast("date"), F.to_date("ts")).alias("age"),
        (F.col("event_id") % 4).cast("int").alias("entities"),
        F.to_date("ts").alias("day"),
    )


def _scored(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d)
    business = business_relevance(F.col("department") < 2, F.col("event_type") == "purchase", F.col("entities"), F.lit(True), F.col("age"))
    temporal = temporal_relevance(F.col("age"), F.col("intent") == "trend")
    score = final_score(F.col("intent"), F.col("similarity"), business, temporal, F.col("entities") / 4)
    return r.withColumn("final_score", recency_boost(score, F.col("age"), F.col("intent") == "trend"))


QUERIES = {
    "sc44_final_score": lambda s, d: _scored(s, d).select("result_id", F.round("final_score", 9).alias("final_score")),
    "sc40_strategy": lambda s, d: _results(s, d).select("intent").distinct().select("intent", by_strategy(F.col("intent"), lambda x: F.lit(x[0])).alias("retrieve"), by_strategy(F.col("intent"), lambda x: F.lit(x[1])).alias("return_k"), by_strategy(F.col("intent"), lambda x: F.lit(x[2])).alias("threshold")),
    "sc47_adaptive_threshold": lambda s, d: _results(s, d).select("result_id", F.round(adaptive_threshold(F.col("intent"), F.when(F.col("department") == 0, "simple").when(F.col("department") == 5, "advanced").otherwise("moderate"), F.col("entities")), 6).alias("threshold")),
    "wn05_diverse_selection": lambda s, d: diverse(_results(s, d), "query_id", [F.desc("similarity"), F.col("result_id")], ["event_type", "department"], 10).select("query_id", "result_id", "rank"),
    "ag12_diversity_metrics": lambda s, d: diversity_metrics(_results(s, d), "query_id", "event_type", "department", "day"),
    "ag14_search_quality": lambda s, d: search_quality(_results(s, d), "query_id", "similarity", "event_type"),
}
_R = """r AS (SELECT user_id AS query_id, event_id AS result_id, event_type, event_id % 6 AS department, ['lookup', 'financial', 'comparison', 'trend', 'other'][user_id % 5 + 1] AS intent, (event_id * 29 % 101) / 100::DOUBLE AS similarity,
 date_diff('day', CAST(ts AS DATE), DATE '2024-02-15') AS age, CAST(event_id % 4 AS INT) AS entities, CAST(ts AS DATE) AS day FROM events)"""
_W = "CASE intent " + " ".join(f"WHEN '{k}' THEN {v[3]!r}".replace("(", "[").replace(")", "]") for k, v in STRATEGIES.items() if k != "default") + f" ELSE {list(STRATEGIES['default'][3])} END"
_PICK = lambda i: "CASE intent " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in STRATEGIES.items() if k != "default") + f" ELSE {STRATEGIES['default'][i]} END"
ORACLE_SQL = {
    "sc44_final_score": f"""WITH {_R}, b AS (SELECT *, ({_W})::DOUBLE[] AS w, CASE WHEN department < 2 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 0.2::DOUBLE ELSE 0 END + least(0.3::DOUBLE, 0.1::DOUBLE * entities) + CASE WHEN age < 30 THEN 0.1::DOUBLE ELSE 0 END AS business,
 CASE WHEN intent <> 'trend' THEN 0.5 WHEN age <= 30 THEN 0.9 WHEN age <= 90 THEN 0.7 WHEN age <= 365 THEN 0.5 ELSE 0.3 END::DOUBLE AS temporal FROM r)
 SELECT result_id, round(least(1::DOUBLE, w[1] * similarity + w[2] * business + w[3] * temporal + w[4] * entities / 4) * CASE WHEN age <= 30 THEN 1.2 WHEN age <= 90 THEN 1.1 ELSE 1.0 END::DOUBLE * CASE WHEN intent = 'trend' AND age > 30 AND age < 365 THEN 1.15 ELSE 1.0 END::DOUBLE, 9) AS final_score FROM b""",
    "sc40_strategy": f"WITH {_R} SELECT DISTINCT intent, {_PICK(0)} AS retrieve, {_PICK(1)} AS return_k, ({_PICK(2)})::DOUBLE AS threshold FROM r",
    "sc47_adaptive_threshold": f"""WITH {_R} SELECT result_id, round(greatest(0.1::DOUBLE, least(0.9::DOUBLE, CASE intent WHEN 'lookup' THEN 0.75 WHEN 'financial' THEN 0.35 WHEN 'comparison' THEN 0.45 WHEN 'trend' THEN 0.25 ELSE 0.5 END::DOUBLE + CASE department WHEN 0 THEN 0.1 WHEN 5 THEN -0.1 ELSE 0 END::DOUBLE - least(0.1::DOUBLE, 0.02::DOUBLE * entities))), 6) AS threshold FROM r""",
    "wn05_diverse_selection": f"""WITH {_R}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, result_id) AS pos FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY query_id, event_type, department ORDER BY pos) AS seen FROM p),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM q WHERE pos <= 5 OR seen = 1) SELECT query_id, result_id, rank FROM t WHERE rank <= 10""",
    "ag12_diversity_metrics": f"""WITH {_R} SELECT query_id, round(count(DISTINCT event_type)::DOUBLE / count(*), 6) AS type_diversity, round(count(DISTINCT department)::DOUBLE / count(*), 6) AS department_diversity, date_diff('day', min(day), max(day)) AS day_spread, round((count(DISTINCT event_type)::DOUBLE / count(*) + count(DISTINCT department)::DOUBLE / count(*)) / 2, 6) AS overall FROM r GROUP BY 1""",
    "ag14_search_quality": f"""WITH {_R} SELECT query_id, round(avg(similarity), 6) AS avg_score, round(least(1::DOUBLE, 0.6::DOUBLE * avg(similarity) + 0.2::DOUBLE * (count(DISTINCT event_type)::DOUBLE / count(*)) + 0.2::DOUBLE * least(1::DOUBLE, count(*)::DOUBLE / 10)), 6) AS quality FROM r GROUP BY 1""",
}
