"""Query understanding as queries: over every turn, document and order in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import questions as Q
from marlstone.plans.samples import ASKED_SQL, any_sql, asked, cases, cases_sql, found_sql, list_sql, screened, text_sql

NAMES = {"customers": ("Larkfield", "Osborne Mills"), "machines": ("machine 7",)}


def parsed(questions: DataFrame) -> DataFrame:
    """DR-06: the whole of query understanding for rows with a column ``question``. Texts are screened for all patterns in one
    pass; those that may match are matched in a step of plain columns, and structs are made of the few values found."""
    out, text, low = Q.cleaned(questions).withColumn("_low", F.lower("cleaned")), F.col("cleaned"), F.col("_low")
    screens = {"_b1": Q.INTENT_PATTERNS, "_b2": Q.ENTITY_PATTERNS, "_b3": Q.CONSTRAINT_PATTERNS, "_b4": Q.TIMES}
    out = out.withColumns({name: screened(low, patterns) for name, patterns in screens.items()})
    scores = {f"_s{k}": c for k, c in enumerate(Q.scores(text, F.col("_b1")))}
    values = {f"_{kind}": c for kind, c in Q.entity_values(text, F.col("_b2")).items()}
    limits = {f"_c{k}": c for k, c in enumerate(Q.constraint_values(text, F.col("_b3")))}
    out = out.withColumns({**scores, **values, **limits, "departments": Q.departments(low), "times": Q.time_references(text, F.col("_b4"))})
    money = F.size("_financial_amount") > 0
    out = out.withColumns(
        {
            "ranked": Q.intents([F.col(c) for c in scores]),
            "entities": Q.entities({kind: F.col(f"_{kind}") for kind in Q.KINDS}),
            "constraints": Q.constraints([F.col(c) for c in limits]),
            "expansion": Q.expansion(low, money),
            "suggested": Q.suggested(F.col("departments"), money),
            "periods": Q.periods(F.col("times")),
        }
    )
    ranges = F.size(F.filter("constraints", lambda c: c["kind"] == "date_range"))
    return out.withColumns(
        {
            "intent": Q.primary(F.col("ranked")),
            "intent_score": Q.primary_score(F.col("ranked")),
            "complexity": Q.complexity(Q.primary(F.col("ranked")), F.size("entities"), F.size("constraints"), ranges),
        }
    ).drop("_low", *screens, *scores, *values, *limits)


def expanded(cleaned: str = "cleaned", expansion: str = "expansion"):
    """DR-06: the question with the first five expansion terms."""
    return F.trim(F.concat_ws(" ", F.col(cleaned), F.array_join(F.slice(expansion, 1, 5), " ")))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return parsed(asked(s, d))


def _sc23(s: SparkSession, d: str) -> DataFrame:
    return _asked(s, d).select("event_id", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["value"])), "|").alias("entities"))


def _sc26(s: SparkSession, d: str) -> DataFrame:
    low = F.col("cleaned")
    return _asked(s, d).select(
        "event_id",
        F.array_join("departments", ",").alias("departments"),
        F.array_join(Q.document_types(low), ",").alias("document_types"),
        F.array_join(Q.processes(low), ",").alias("processes"),
        cases(F.lower(low), Q.SCOPES, "current").alias("scope"),
        cases(F.lower(low), Q.SENSITIVITY, "normal").alias("sensitivity"),
    )


def _ag40(s: SparkSession, d: str) -> DataFrame:
    score = Q.confidence(F.col("intent_score"), F.col("entities"), F.col("constraints"))
    full = Q.completeness(F.col("intent_score"), F.size("entities"), F.size("constraints"), F.size("expansion"), F.size("suggested"), F.size("times") + F.size("periods"))
    return _asked(s, d).select("event_id", F.round(score, 6).alias("confidence"), F.round(full, 6).alias("completeness"), (score >= 0.3).alias("is_valid"))


def _sc22(s: SparkSession, d: str) -> DataFrame:
    e = Q.named_entities(F.col("question"), NAMES)
    return _asked(s, d).select("event_id", F.array_join(F.transform(e, lambda x: F.concat_ws(":", x["kind"], x["value"], F.coalesce(x["context"], F.lit("-")))), "|").alias("entities"))


QUERIES = {
    "sc20_clean_query": lambda s, d: _asked(s, d).select("event_id", "cleaned"),
    "sc21_intents": lambda s, d: _asked(s, d).select("event_id", "intent", "intent_score", F.array_join(Q.secondary(F.col("ranked")), ",").alias("secondary")),
    "sc22_named_entities": _sc22,
    "sc23_regex_entities": _sc23,
    "sc24_constraints": lambda s, d: _asked(s, d).select("event_id", F.array_join(F.transform("constraints", lambda c: F.concat_ws(":", c["kind"], c["operator"], c["value"])), "|").alias("constraints")),
    "sc25_expansion": lambda s, d: _asked(s, d).select("event_id", F.array_join("expansion", ",").alias("expansion")),
    "sc26_business_context": _sc26,
    "sc27_complexity": lambda s, d: _asked(s, d).select("event_id", "complexity"),
    "sc28_departments": lambda s, d: _asked(s, d).select("event_id", F.array_join("suggested", ",").alias("suggested")),
    "sc29_times": lambda s, d: _asked(s, d).select("event_id", F.array_join("times", "|").alias("times"), F.array_join("periods", ",").alias("periods")),
    "ag40_confidence": _ag40,
    "dr06_expanded_query": lambda s, d: _asked(s, d).select("event_id", expanded().alias("expanded")),
}


def _clean_sql() -> str:
    out = "lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g'))"
    for pattern, to in Q.REWRITES:
        out = f"regexp_replace({out}, {text_sql('(?i)' + pattern)}, {text_sql(to)}, 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


def _ranked_sql() -> str:
    one = []
    for k, (name, patterns) in enumerate(Q.INTENTS.items()):
        hits = " + ".join(f"CASE WHEN regexp_matches(cleaned, {text_sql('(?i)' + p)}) THEN {2 if 'specific' in p else 1} ELSE 0 END" for p in patterns)
        one.append(f"{{'score': ({hits}) / {len(patterns)}::DOUBLE, 'place': {-k}, 'name': {text_sql(name)}}}")
    return f"list_reverse_sort(list_filter([{', '.join(one)}], lambda s: s.score > 0))"


def _kinds_sql() -> str:
    one = lambda kind, ps: f"list_transform({found_sql('cleaned', ps)}, lambda v: {text_sql(kind)} || ':' || v)"
    # a letter beyond ASCII is part of a word, which this dialect's word boundary doesn't know
    one_word = one("reference_id", Q.REFERENCES).replace("(cleaned,", "(regexp_replace(cleaned, '[^\\x00-\\x7F\\p{P}\\p{S}\\p{Z}\\p{C}]', '_', 'g'),")
    return f"list_concat(list_concat({one('financial_amount', Q.AMOUNTS)}, {one('date', Q.DATES)}), {one_word})"


def _constraints_sql() -> str:
    parts = [f"list_transform(list_zip(regexp_extract_all(cleaned, {text_sql(p)}, 1), regexp_extract_all(cleaned, {text_sql(p)}, 2)), lambda z: 'date_range:between:' || z[1] || '..' || z[2])" for p in Q.RANGES]
    parts += [f"list_transform(regexp_extract_all(cleaned, {text_sql(p)}, 1), lambda v: 'amount:{op}:' || replace(v, ',', ''))" for p, op in Q.LIMITS]
    parts.append(f"list_transform(regexp_extract_all(cleaned, {text_sql(Q.DEPARTMENT)}, 1), lambda v: 'department:equals:' || lower(v))")
    return "flatten([" + ", ".join(parts) + "])"


def _list_if(cond: str, values) -> str:
    return f"CASE WHEN {cond} THEN {list_sql(values)} ELSE [] END"


_MONEY = "len(list_filter(entities, lambda e: starts_with(e, 'financial_amount:'))) > 0"
_EXPANSION = (
    "list_sort(list_distinct(flatten(["
    + ", ".join(
        [_list_if(f"list_contains(string_split(lower(cleaned), ' '), {text_sql(k.lower())})", v) for k, v in Q.SYNONYMS.items()]
        + [_list_if(_MONEY, ("amount", "money", "cost", "value"))]
        + [_list_if(any_sql("lower(cleaned)", terms), terms) for terms, _ in Q.CONTEXTS.values()]
    )
    + "])))"
)
_DEPARTMENTS = "flatten([" + ", ".join(_list_if(any_sql("lower(cleaned)", t), (n,)) for n, (t, _) in Q.CONTEXTS.items()) + "])"
_TYPES = "flatten([" + ", ".join(_list_if(any_sql("lower(cleaned)", t), k) for t, k in Q.CONTEXTS.values()) + "])"
_PROCESSES = "flatten([" + ", ".join(_list_if(any_sql("lower(cleaned)", t), (n,)) for n, t in Q.PROCESSES.items()) + "])"
_TIMES = "flatten([" + ", ".join(f"regexp_extract_all(cleaned, {text_sql(p)}, 0)" for p in Q.TIMES) + "])"
_PERIODS = "list_filter(list_transform(times, lambda r: CASE " + " ".join(f"WHEN lower(r) IN ({', '.join(map(text_sql, w))}) THEN {text_sql(n)}" for n, w in Q.PERIODS.items()) + " END), lambda p: p IS NOT NULL)"
_WITH = f"""WITH a AS ({ASKED_SQL}), b AS (SELECT *, {_clean_sql()} AS cleaned FROM a),
 c AS (SELECT *, {_ranked_sql()} AS ranked, {_kinds_sql()} AS entities, {_constraints_sql()} AS constraints, {_DEPARTMENTS} AS departments, {_TIMES} AS times FROM b),
 p AS (SELECT *, coalesce(ranked[1].name, 'unknown') AS intent, coalesce(ranked[1].score, 0::DOUBLE) AS intent_score, {_EXPANSION} AS expansion, list_sort(list_distinct(list_concat(departments, {_list_if(_MONEY, ('accounting',))}))) AS suggested, {_PERIODS} AS periods,
  len(list_filter(constraints, lambda c: starts_with(c, 'date_range'))) AS n_range, len(list_filter(constraints, lambda c: starts_with(c, 'department'))) AS n_dept, len(list_filter(entities, lambda e: starts_with(e, 'date:'))) AS n_date FROM c)
 """
_POINTS = "CASE WHEN len(entities) > 2 THEN 1 ELSE 0 END + CASE WHEN len(constraints) > 1 THEN 1 ELSE 0 END + CASE WHEN intent IN ('analysis_comparison', 'analysis_trend', 'analysis_financial') THEN 2 ELSE 0 END + CASE WHEN intent = 'operational_workflow' THEN 3 ELSE 0 END + CASE WHEN n_range > 0 THEN 1 ELSE 0 END"
_OF_ENTITIES = "CASE WHEN len(entities) = 0 THEN 0.3::DOUBLE ELSE least(1::DOUBLE, (0.9::DOUBLE * n_date + 0.95::DOUBLE * (len(entities) - n_date)) / len(entities) + 0.1::DOUBLE * (len(entities) - n_date) / len(entities)) END"
_OF_CONSTRAINTS = "CASE WHEN len(constraints) = 0 THEN 0.7::DOUBLE ELSE (len(constraints) - n_dept + 0.8::DOUBLE * n_dept) / len(constraints) END"
_SCORE = f"(intent_score * 0.4::DOUBLE + ({_OF_ENTITIES}) * 0.3::DOUBLE + ({_OF_CONSTRAINTS}) * 0.3::DOUBLE)"
_SHARE = " + ".join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0 END" for c, v in (("len(entities) > 0", 0.2), ("len(constraints) > 0", 0.15), ("true", 0.15), ("len(expansion) > 0", 0.1), ("len(suggested) > 0", 0.1), ("len(times) > 0", 0.05)))
_NAMED = ", ".join(
    f"CASE WHEN contains(lower(question), {text_sql(n.lower())}) THEN {text_sql(k + ':' + n + ':')} || coalesce((SELECT array_to_string(list_slice(w, greatest(pos - 3, 1), pos + 3), ' ') FROM (SELECT w, list_position(list_transform(w, lambda x: contains(lower(x), {text_sql(n.lower())})), true) AS pos FROM (SELECT string_split_regex(question, '\\s+') AS w)) WHERE pos > 0), '-') END"
    for k, names in NAMES.items()
    for n in names
)
ORACLE_SQL = {
    "sc20_clean_query": _WITH + "SELECT event_id, cleaned FROM p",
    "sc21_intents": _WITH + "SELECT event_id, intent, intent_score, array_to_string(list_transform(list_filter(ranked[2:], lambda s: s.score > 0.3 AND s.score > intent_score * 0.5), lambda s: s.name), ',') AS secondary FROM p",
    "sc22_named_entities": _WITH + f"SELECT event_id, array_to_string(list_filter([{_NAMED}], lambda x: x IS NOT NULL), '|') AS entities FROM p",
    "sc23_regex_entities": _WITH + "SELECT event_id, array_to_string(entities, '|') AS entities FROM p",
    "sc24_constraints": _WITH + "SELECT event_id, array_to_string(constraints, '|') AS constraints FROM p",
    "sc25_expansion": _WITH + "SELECT event_id, array_to_string(expansion, ',') AS expansion FROM p",
    "sc26_business_context": _WITH
    + f"SELECT event_id, array_to_string(departments, ',') AS departments, array_to_string({_TYPES}, ',') AS document_types, array_to_string({_PROCESSES}, ',') AS processes, {cases_sql('lower(cleaned)', Q.SCOPES, text_sql('current'))} AS scope, {cases_sql('lower(cleaned)', Q.SENSITIVITY, text_sql('normal'))} AS sensitivity FROM p",
    "sc27_complexity": _WITH + f"SELECT event_id, CASE WHEN {_POINTS} >= 4 THEN 'advanced' WHEN {_POINTS} >= 2 THEN 'complex' WHEN {_POINTS} >= 1 THEN 'moderate' ELSE 'simple' END AS complexity FROM p",
    "sc28_departments": _WITH + "SELECT event_id, array_to_string(suggested, ',') AS suggested FROM p",
    "sc29_times": _WITH + "SELECT event_id, array_to_string(times, '|') AS times, array_to_string(periods, ',') AS periods FROM p",
    "ag40_confidence": _WITH + f"SELECT event_id, round({_SCORE}, 6) AS confidence, round(CASE WHEN intent_score > 0.7 THEN 0.25::DOUBLE WHEN intent_score > 0.4 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END + {_SHARE}, 6) AS completeness, {_SCORE} >= 0.3 AS is_valid FROM p",
    "dr06_expanded_query": _WITH + "SELECT event_id, trim(cleaned || ' ' || array_to_string(expansion[1:5], ' ')) AS expanded FROM p",
}
