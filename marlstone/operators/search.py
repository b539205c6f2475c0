"""Search rules after retrieval: overlaps, gates, boosts, routes, temporal order, departments, classes and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.questions import CONTEXTS
from marlstone.operators.questions import _WITH, _asked
from marlstone.plans.samples import any_of, any_sql, count_of, count_sql, list_sql, pick, text_sql
from marlstone.session import table

# Routes with their steps, reference patterns, strategy labels.
ROUTES = {
    "lookup_specific": ("exact_match_priority", ("entity_extraction", "id_normalization"), ()),
    "analysis_financial": ("financial_analysis", ("currency_normalization", "date_parsing", "amount_extraction"), ("financial_validation", "calculation_verification")),
    "analysis_comparison": ("comparative_analysis", ("entity_pair_extraction", "comparison_term_identification"), ("result_pairing", "contrast_highlighting")),
    "analysis_trend": ("temporal_analysis", ("temporal_parsing", "trend_term_extraction"), ("temporal_grouping", "trend_calculation")),
}
CROSS_REFERENCES = (r"(?i)ref[:\s]*([A-Z0-9-]+)", r"(?i)invoice[:\s]*([A-Z0-9-]+)", r"(?i)order[:\s]*([A-Z0-9-]+)", r"(?i)lc[:\s]*([A-Z0-9-]+)")
LABELS = {"lookup_specific": "specific_entity_search", "analysis_financial": "financial_analysis_search", "analysis_comparison": "comparative_search", "analysis_trend": "temporal_trend_search"}
MONEY = ("cost", "expense", "amount", "money")
ACTIONS = {"commercial": "Consider customer impact and delivery commitments", "production": "Assess production schedule and capacity implications", "accounting": "Review financial impact and budget implications"}


def entity_overlap(snippet: Column, entities) -> Column:
    """SC-43: the share of the entities that the snippet holds; 0 without entities."""
    return count_of(F.lower(snippet), entities) / len(entities) if entities else F.lit(0.0)


def relevant(rows: DataFrame, score: str, least: float = 0.3) -> DataFrame:
    """PF-15."""
    return rows.filter(F.col(score) >= least)


def cross_references(snippet: Column) -> Column:
    """SC-45: what follows ref, invoice, order or lc; distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(snippet, F.lit(p), F.lit(1)) for p in CROSS_REFERENCES])))


def related(edges: DataFrame, kinds=("cross_reference", "temporal_sequence", "business_related"), k: int = 5) -> DataFrame:
    """SC-45, DR-20: the first ``k`` targets (edges: source, target, kind, place) of the kinds that relate documents."""
    w = Window.partitionBy("source").orderBy("place", "target")
    return edges.filter(F.col("kind").isin(*kinds)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("source", "target", "n")


def route(intent: Column, complexity: Column, n_constraints: Column) -> Column:
    """SC-49: struct of route, steps before and steps after."""
    name, before, after = F.lit("standard"), F.array().cast("array<string>"), F.array().cast("array<string>")
    for key, (to, pre, post) in ROUTES.items():
        hit = intent == key
        name = F.when(hit, to).otherwise(name)
        before = F.when(hit, F.array(*map(F.lit, pre))).otherwise(before)
        after = F.when(hit, F.array(*map(F.lit, post)) if post else F.array().cast("array<string>")).otherwise(after)
    hard = complexity.isin("complex", "advanced")
    add = lambda steps, cond, step: F.when(cond, F.array_append(steps, F.lit(step))).otherwise(steps)
    before = add(add(before, hard, "complex_query_decomposition"), n_constraints > 0, "constraint_validation")
    return F.struct(name.alias("route"), before.alias("before"), add(after, hard, "multi_perspective_synthesis").alias("after"))


def boosted(score: Column, boost: Column) -> Column:
    """SC-50: the score times one and the boost, which counts 1 at most."""
    return score * (1 + F.least(F.lit(1.0), boost))


def business_boost(question: Column, customers: Column, staff: Column, department: Column, priority: Column, has_money: Column, has_dates: Column) -> Column:
    """SC-50: 0.3 for each customer and 0.2 for each member of staff in the question, 0.25 department, 0.4 or 0.2 priority, 0.3
    money, 0.2 dates."""
    low = F.lower(question)
    named = lambda names: F.size(F.filter(names, lambda n: F.contains(low, F.lower(n))))
    level = F.when((priority == "critical") & any_of(low, ("urgent", "critical", "important")), 0.4).when((priority == "high") & any_of(low, ("high", "priority")), 0.2).otherwise(0.0)
    return (
        named(customers) * 0.3
        + named(staff) * 0.2
        + F.when((department != "") & F.contains(low, F.lower(department)), 0.25).otherwise(0.0)
        + level
        + F.when(has_money & any_of(low, ("payment", "amount", "money", "cost", "price", "financial")), 0.3).otherwise(0.0)
        + F.when(has_dates & any_of(low, ("date", "time", "when", "schedule")), 0.2).otherwise(0.0)
    )


def simple_relevance(in_department: Column, intent: Column, snippet: Column, holds_entity: Column, age_days: Column) -> Column:
    """SC-51: 0.4 department, 0.3 intent, 0.2 or 0.1 by age, at most 1."""
    fits = F.when(intent == "analysis_financial", any_of(F.lower(snippet), MONEY)).when(intent == "lookup_specific", holds_entity).otherwise(False)
    age = F.when(age_days < 30, 0.2).when(age_days < 90, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(in_department, 0.4).otherwise(0.0) + F.when(fits, 0.3).otherwise(0.0) + age)


def simple_score(similarity: Column, business: Column, entity: Column) -> Column:
    """SC-51: 0.5, 0.3 and 0.2 of the three; entity is 0.5 where the question names none."""
    return 0.5 * similarity + 0.3 * business + 0.2 * F.coalesce(entity, F.lit(0.5))


def strategy_label(intent: Column) -> Column:
    """SC-52."""
    out = F.lit("general_semantic_search")
    for key, to in LABELS.items():
        out = F.when(intent == key, to).otherwise(out)
    return out


def factors(in_department: Column, department: Column, fits: Column, intent: Column, age_days: Column) -> Column:
    """SC-52: why a result is relevant."""
    return F.array_compact(F.array(F.when(in_department, F.concat(F.lit("Department match: "), department)), F.when(fits, F.concat(F.lit("Intent match: "), intent)), F.when(age_days < 30, F.lit("Recent document"))))


def is_temporal(intent: Column, n_periods: Column, n_times: Column) -> Column:
    """PF-22."""
    return (intent == "analysis_trend") | (n_periods > 0) | (n_times > 0)


def by_time(intent: Column, question: Column) -> Column:
    """PF-22: whether results go by date."""
    return (intent == "analysis_trend") & F.contains(F.lower(question), F.lit("over time"))


def ranked_results(rows: DataFrame, query: str, score: str, created: str, timed: str, place: str) -> DataFrame:
    """TK-03, TK-04: ``rank`` by score, or by date, newest first, where ``timed``; retrieval order on ties."""
    key = F.when(F.col(timed), F.unix_micros(F.col(created)).cast("double")).otherwise(F.col(score))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(key), place)))


def alignment(snippet: Column, terms, keywords, suggested: Column) -> Column:
    """SC-54: 0.4 of the share of terms, 0.4 of the share of keywords, 0.2 if the question suggests the department, over the
    weights that count; 0.7 at least."""
    low = F.lower(snippet)
    raw = 0.4 * count_of(low, terms) / len(terms) + 0.4 * count_of(low, keywords) / len(keywords) + F.when(suggested, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.7), raw / (0.8 + F.when(suggested, 0.2).otherwise(0.0)))


def primary_department(given: Column, suggested: Column, snippet: Column, contexts: dict = CONTEXTS) -> Column:
    """SC-53: the result's own, else the first suggested, else that with the most terms, the first defined on ties."""
    low = F.lower(snippet)
    best = F.array_max(F.array(*[F.struct(count_of(low, terms).alias("n"), F.lit(-k).alias("place"), F.lit(name).alias("name")) for k, (name, (terms, _)) in enumerate(contexts.items())]))
    return F.coalesce(F.nullif(given, F.lit("")), F.get(suggested, F.lit(0)), best["name"])


def contextual_relevance(impact: Column, align: Column, temporal: Column, age_days: Column) -> Column:
    """SC-58: highly, moderately, historically, else tangentially relevant."""
    return (
        F.when((impact > 0.8) & (align > 0.7) & (temporal > 0.6), "highly_relevant")
        .when((impact > 0.6) & (align > 0.5), "moderately_relevant")
        .when((age_days > 90) & (impact > 0.4), "historically_relevant")
        .otherwise("tangentially_relevant")
    )


def actions(relevance: Column, peak: Column, others: Column, age_days: Column, department: Column) -> Column:
    """SC-58, TK-10: the first three actions."""
    high = relevance == "highly_relevant"
    by_department = F.lit(None).cast("string")
    for name, text in ACTIONS.items():
        by_department = F.when(department == name, text).otherwise(by_department)
    each = F.array(
        F.when(high, F.lit("Review immediately - high business relevance")),
        F.when(high & peak, F.lit("Priority action during peak export season")),
        F.when(F.size(others) > 1, F.concat(F.lit("Coordinate with "), F.array_join(others, ", "), F.lit(" departments"))),
        F.when(age_days > 90, "Verify information currency before acting").when(age_days <= 7, "Recent information - suitable for immediate decisions"),
        by_department,
    )
    return F.slice(F.array_compact(each), 1, 3)


def insights(pattern: Column, match: Column, others: Column, impact: Column) -> Column:
    """SC-58: what the relationships and the impact say. ``pattern``: the best one's name with blanks and its departments."""
    return F.array_compact(
        F.array(
            F.when(match > 0, F.concat(F.lit("Part of "), pattern)),
            F.when(match > 3, F.lit("Strong cross-functional integration detected")),
            F.when(F.size(others) > 1, F.concat(F.lit("Involves collaboration across "), (F.size(others) + 1).cast("string"), F.lit(" departments"))),
            F.when(impact > 0.8, "High business impact - affects multiple operational areas").when(impact > 0.6, "Moderate business impact - departmental significance"),
        )
    )


ENTITIES = ("Larkfield", "Machine 7", "LC-9921", "PO-118")
KEYWORDS = {"accounting": ("payment", "balance", "budget", "due", "profit")}


def _results(s: SparkSession, d: str) -> DataFrame:
    """Every question with one result: its own text, its department, an age and made-up scores."""
    k = F.col("event_id")
    q = _asked(s, d).select("event_id", "question", "department", "intent", "complexity", "constraints", "suggested", "times", "periods")
    rows = q.select(
        "*",
        F.col("question").alias("snippet"),
        (k * 37 % 400).alias("age"),
        (k * 29 % 101 / 100).alias("similarity"),
        (k * 7 % 11 / 10).alias("business"),
        (k * 13 % 17 / 16).alias("impact"),
    )
    return rows.withColumn("in_department", F.array_contains("suggested", F.col("department")))


def _simple(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("snippet")
    rows = _results(s, d).withColumn("relevance", simple_relevance(F.col("in_department"), F.col("intent"), F.col("snippet"), any_of(low, ENTITIES), F.col("age")))
    fits = F.when(F.col("intent") == "analysis_financial", any_of(low, MONEY)).otherwise(True)
    return rows.select(
        "event_id",
        F.round("relevance", 6).alias("relevance"),
        F.round(simple_score(F.col("similarity"), F.col("relevance"), entity_overlap(F.col("snippet"), ENTITIES)), 6).alias("score"),
        strategy_label(F.col("intent")).alias("strategy"),
        F.array_join(factors(F.col("in_department"), F.col("department"), fits, F.col("intent"), F.col("age")), "|").alias("factors"),
    )


def _routes(s: SparkSession, d: str) -> DataFrame:
    r = _asked(s, d).withColumn("r", route(F.col("intent"), F.col("complexity"), F.size("constraints")))
    return r.select("event_id", "r.route", F.array_join("r.before", ",").alias("before"), F.array_join("r.after", ",").alias("after"))


def _context(s: SparkSession, d: str) -> DataFrame:
    rows = _results(s, d).withColumn("align", alignment(F.col("snippet"), CONTEXTS["accounting"][0], KEYWORDS["accounting"], F.array_contains("suggested", "accounting")))
    rows = rows.withColumn("class", contextual_relevance(F.col("impact"), F.col("align"), F.col("business"), F.col("age")))
    department = primary_department(F.col("department"), F.col("suggested"), F.col("snippet"))
    return rows.select(
        "event_id",
        F.round("align", 6).alias("align"),
        "class",
        department.alias("primary"),
        F.array_join(actions(F.col("class"), F.col("event_id") % 2 == 0, F.col("suggested"), F.col("age"), department), "|").alias("actions"),
        F.array_join(insights(F.lit("Order To Cash involving commercial, accounting"), F.col("event_id") % 6, F.col("suggested"), F.col("impact")), "|").alias("insights"),
    )


def _boosts(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d).withColumn("priority", pick(("critical", "high", "medium"), F.col("event_id")))
    b = business_boost(F.col("question"), F.array(F.lit("Larkfield")), F.array(F.lit("staff")), F.col("department"), F.col("priority"), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0)
    return r.select("event_id", F.round(boosted(F.col("similarity"), b), 6).alias("score"))


def _temporal(s: SparkSession, d: str) -> DataFrame:
    return _asked(s, d).select("event_id", is_temporal(F.col("intent"), F.size("periods"), F.size("times")).alias("temporal"), by_time(F.col("intent"), F.col("question")).alias("by_time"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("created"), (F.col("event_id") * 29 % 11 / 10).alias("score"), (F.col("user_id") % 2 == 0).alias("timed"))
    return ranked_results(e, "user_id", "score", "created", "timed", "event_id").select("user_id", "event_id", "rank")


QUERIES = {
    "sc43_entity_overlap": lambda s, d: _results(s, d).select("event_id", entity_overlap(F.col("snippet"), ENTITIES).alias("overlap")),
    "pf15_relevant": lambda s, d: relevant(_results(s, d), "business").select("event_id", "business"),
    "sc45_cross_references": lambda s, d: _results(s, d).select("event_id", F.array_join(cross_references(F.col("snippet")), ",").alias("refs")),
    "sc45_related": lambda s, d: related(table(s, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), pick(("cross_reference", "other", "business_related"), F.col("l_partkey")).alias("kind"), F.col("l_linenumber").alias("place")), k=2),
    "sc49_routes": _routes,
    "sc50_boosts": _boosts,
    "sc51_simple_scores": _simple,
    "sc53_context": _context,
    "pf22_temporal": _temporal,
    "tk03_ranked": _ranked,
}
_R = _WITH + f""", r AS (SELECT *, question AS snippet, lower(question) AS low, event_id * 37 % 400 AS age,
 event_id * 29 % 101 / 100::DOUBLE AS similarity, event_id * 7 % 11 / 10::DOUBLE AS business, event_id * 13 % 17 / 16::DOUBLE AS impact, list_contains(suggested, department) AS in_department,
 CASE WHEN n_points >= 4 THEN 'advanced' WHEN n_points >= 2 THEN 'complex' WHEN n_points >= 1 THEN 'moderate' ELSE 'simple' END AS complexity FROM (SELECT *, CASE WHEN len(entities) > 2 THEN 1 ELSE 0 END + CASE WHEN len(constraints) > 1 THEN 1 ELSE 0 END + CASE WHEN intent IN ('analysis_comparison', 'analysis_trend', 'analysis_financial') THEN 2 ELSE 0 END + CASE WHEN intent = 'operational_workflow' THEN 3 ELSE 0 END + CASE WHEN n_range > 0 THEN 1 ELSE 0 END AS n_points FROM p))
 """
_JOIN = lambda items, sep: f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), '{sep}')"
_REL = f"least(1::DOUBLE, CASE WHEN in_department THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN (intent = 'analysis_financial' AND {any_sql('low', MONEY)}) OR (intent = 'lookup_specific' AND {any_sql('low', ENTITIES)}) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN age < 30 THEN 0.2::DOUBLE WHEN age < 90 THEN 0.1::DOUBLE ELSE 0 END)"
_OVERLAP = f"{count_sql('low', ENTITIES)} / {len(ENTITIES)}::DOUBLE"
_STEPS = lambda k: "CASE intent " + " ".join(f"WHEN {text_sql(n)} THEN {list_sql(v[k])}" for n, v in ROUTES.items()) + " ELSE [] END"
_HARD = "complexity IN ('complex', 'advanced')"
_ACC = "list_contains(suggested, 'accounting')"
_ALIGN = f"greatest(0.7::DOUBLE, (0.4::DOUBLE * {count_sql('low', CONTEXTS['accounting'][0])} / 7 + 0.4::DOUBLE * {count_sql('low', KEYWORDS['accounting'])} / 5 + CASE WHEN {_ACC} THEN 0.2::DOUBLE ELSE 0 END) / (0.8::DOUBLE + CASE WHEN {_ACC} THEN 0.2::DOUBLE ELSE 0 END))"
_BEST = "list_max([" + ", ".join(f"{{'n': {count_sql('low', terms)}, 'place': {-k}, 'name': {text_sql(name)}}}" for k, (name, (terms, _)) in enumerate(CONTEXTS.items())) + "]).name"
_Q = "lower(question)"
ORACLE_SQL = {
    "sc43_entity_overlap": _R + f"SELECT event_id, {_OVERLAP} AS overlap FROM r",
    "pf15_relevant": _R + "SELECT event_id, business FROM r WHERE business >= 0.3",
    "sc45_cross_references": _R + "SELECT event_id, array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(snippet, {text_sql(p)}, 1)" for p in CROSS_REFERENCES) + "]))), ',') AS refs FROM r",
    "sc45_related": "SELECT l_orderkey AS source, l_partkey AS target, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_partkey % 3 <> 1) WHERE n <= 2",
    "sc49_routes": _R + "SELECT event_id, CASE intent " + " ".join(f"WHEN {text_sql(n)} THEN {text_sql(v[0])}" for n, v in ROUTES.items()) + f" ELSE 'standard' END AS route, array_to_string(list_concat(list_concat({_STEPS(1)}, CASE WHEN {_HARD} THEN ['complex_query_decomposition'] ELSE [] END), CASE WHEN len(constraints) > 0 THEN ['constraint_validation'] ELSE [] END), ',') AS before, array_to_string(list_concat({_STEPS(2)}, CASE WHEN {_HARD} THEN ['multi_perspective_synthesis'] ELSE [] END), ',') AS after FROM r",
    "sc50_boosts": _R
    + f"SELECT event_id, round(similarity * (1 + least(1::DOUBLE, CASE WHEN contains({_Q}, 'larkfield') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN contains({_Q}, 'staff') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN department <> '' AND contains({_Q}, department) THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN event_id % 3 = 0 AND {any_sql(_Q, ('urgent', 'critical', 'important'))} THEN 0.4::DOUBLE WHEN event_id % 3 = 1 AND {any_sql(_Q, ('high', 'priority'))} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN event_id % 2 = 0 AND {any_sql(_Q, ('payment', 'amount', 'money', 'cost', 'price', 'financial'))} THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN event_id % 3 = 0 AND {any_sql(_Q, ('date', 'time', 'when', 'schedule'))} THEN 0.2::DOUBLE ELSE 0 END)), 6) AS score FROM r",
    "sc51_simple_scores": _R
    + f"SELECT event_id, round({_REL}, 6) AS relevance, round(0.5::DOUBLE * similarity + 0.3::DOUBLE * {_REL} + 0.2::DOUBLE * {_OVERLAP}, 6) AS score, CASE intent {' '.join(f'WHEN {text_sql(k)} THEN {text_sql(v)}' for k, v in LABELS.items())} ELSE 'general_semantic_search' END AS strategy, "
    + _JOIN(["CASE WHEN in_department THEN 'Department match: ' || department END", f"CASE WHEN intent <> 'analysis_financial' OR {any_sql('low', MONEY)} THEN 'Intent match: ' || intent END", "CASE WHEN age < 30 THEN 'Recent document' END"], "|")
    + " AS factors FROM r",
    "sc53_context": _R
    + f", x AS (SELECT *, {_ALIGN} AS align, coalesce(nullif(department, ''), suggested[1], {_BEST}) AS prim FROM r), y AS (SELECT *, CASE WHEN impact > 0.8 AND align > 0.7 AND business > 0.6 THEN 'highly_relevant' WHEN impact > 0.6 AND align > 0.5 THEN 'moderately_relevant' WHEN age > 90 AND impact > 0.4 THEN 'historically_relevant' ELSE 'tangentially_relevant' END AS class FROM x) SELECT event_id, round(align, 6) AS align, class, prim AS \"primary\", array_to_string(list_filter(["
    + ", ".join(["CASE WHEN class = 'highly_relevant' THEN 'Review immediately - high business relevance' END", "CASE WHEN class = 'highly_relevant' AND event_id % 2 = 0 THEN 'Priority action during peak export season' END", "CASE WHEN len(suggested) > 1 THEN 'Coordinate with ' || array_to_string(suggested, ', ') || ' departments' END", "CASE WHEN age > 90 THEN 'Verify information currency before acting' WHEN age <= 7 THEN 'Recent information - suitable for immediate decisions' END", "CASE prim " + " ".join(f"WHEN {text_sql(k)} THEN {text_sql(v)}" for k, v in ACTIONS.items()) + " END"])
    + "], lambda v: v IS NOT NULL)[1:3], '|') AS actions, "
    + _JOIN(["CASE WHEN event_id % 6 > 0 THEN 'Part of Order To Cash involving commercial, accounting' END", "CASE WHEN event_id % 6 > 3 THEN 'Strong cross-functional integration detected' END", "CASE WHEN len(suggested) > 1 THEN 'Involves collaboration across ' || (len(suggested) + 1) || ' departments' END", "CASE WHEN impact > 0.8 THEN 'High business impact - affects multiple operational areas' WHEN impact > 0.6 THEN 'Moderate business impact - departmental significance' END"], "|")
    + " AS insights FROM y",
    "pf22_temporal": _R + f"SELECT event_id, intent = 'analysis_trend' OR len(periods) > 0 OR len(times) > 0 AS temporal, intent = 'analysis_trend' AND contains({_Q}, 'over time') AS by_time FROM r",
    "tk03_ranked": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN user_id % 2 = 0 THEN epoch_us(ts)::DOUBLE ELSE event_id * 29 % 11 / 10::DOUBLE END DESC, event_id) AS rank FROM events",
}
