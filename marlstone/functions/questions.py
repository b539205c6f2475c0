"""Query understanding: rewrites, intents, entities, constraints, expansion, business context, complexity, confidence.

The rule tables are the reference's. Where its code misses its own intent they follow the intent: names in capitals are
compared in lower case, and period words are accepted before and after the rewrites (``last`` and ``previous``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.samples import any_of, is_set, matches, may_hold

# Rewrites in their order, intents with their patterns, entity, constraint and time patterns, word lists.
REWRITES = (
    (r"\bwhat\s+are\s+", "show "),
    (r"\bwhat\s+is\s+", "show "),
    (r"\btell\s+me\s+about\s+", "show "),
    (r"\bcan\s+you\s+(?:show|find|get)\s+", ""),
    (r"\bplease\s+", ""),
    (r"\bi\s+need\s+(?:to\s+)?(?:see|find|get)\s+", "show "),
    (r"\bmhm\s+machine", "MHM embroidery machine"),
    (r"\b(?:rb\s+knit|rbknit)", "RB Knit"),
    (r"\b(?:blue\s+planet|blueplanet)", "Blue Planet Knitwear Ltd"),
    (r"\bcommercial\s+dept", "commercial department"),
    (r"\bproduction\s+dept", "production department"),
    (r"\blast\s+quarter", "previous quarter"),
    (r"\bthis\s+quarter", "current quarter"),
    (r"\blast\s+month", "previous month"),
    (r"\bthis\s+month", "current month"),
)
INTENTS = {
    "lookup_specific": (
        r"\b(?:find|show|get|fetch)\s+(?:me\s+)?(?:the\s+)?(?:specific\s+)?(?:document|file|record|transaction)",
        r"\b(?:where\s+is|locate)\s+",
        r"\b(?:id|reference|number)\s*[:=]\s*\w+",
        r"\b(?:transaction|invoice|order|lc)\s+(?:number|id|ref)",
    ),
    "lookup_filtered": (
        r"\b(?:find|show|list|get)\s+(?:all\s+)?(?:documents|files|records|transactions)",
        r"\bwhere\s+\w+\s*(?:is|equals|contains)",
        r"\b(?:from|by|for|with)\s+(?:customer|department|staff|machine)",
        r"\b(?:between|during|in)\s+(?:dates?|months?|quarters?)",
    ),
    "analysis_financial": (
        r"\b(?:calculate|compute|analyze|what.*cost|what.*total)",
        r"\b(?:expenses?|revenue|profit|loss|budget)",
        r"\b(?:financial|money|amount|cost|spend|earned)",
        r"\bhow\s+much\s+(?:did\s+we\s+)?(?:spend|earn|pay|receive)",
    ),
    "analysis_comparison": (
        r"\b(?:compare|comparison|versus|vs\.?|difference|against)",
        r"\b(?:higher|lower|more|less|better|worse)\s+than",
        r"\b(?:which\s+(?:is\s+)?(?:better|higher|lower|more|less))",
        r"\bbetween\s+\w+\s+and\s+\w+",
    ),
    "analysis_trend": (
        r"\b(?:trend|trending|pattern|growth|decline|increase|decrease)",
        r"\b(?:over\s+time|across\s+(?:months?|quarters?|years?))",
        r"\b(?:historical|history|past|previous|last\s+\d+)",
        r"\bhow\s+(?:has|have)\s+\w+\s+changed",
    ),
    "summary_overview": (
        r"\b(?:summary|overview|summarize|brief|outline)",
        r"\b(?:give\s+me\s+an?\s+)?(?:overview|summary|brief)",
        r"\bwhat.*(?:happened|occurred|status)",
        r"\btell\s+me\s+about",
    ),
    "summary_totals": (
        r"\b(?:total|sum|aggregate|count|how\s+many)",
        r"\b(?:add\s+up|sum\s+up|total\s+up)",
        r"\bhow\s+much\s+(?:in\s+total|altogether|overall)",
        r"\bwhat.*(?:total|grand\s+total)",
    ),
    "operational_status": (
        r"\b(?:status|current|now|today|present|ongoing)",
        r"\bwhat.*(?:happening|going\s+on|current)",
        r"\b(?:active|pending|in\s+progress|completed)",
        r"\bhow.*(?:doing|performing|running)",
    ),
    "operational_workflow": (
        r"\b(?:process|workflow|procedure|steps|how\s+to)",
        r"\bwhat.*(?:process|steps|procedure)",
        r"\bhow\s+(?:do\s+we|to|should\s+we)",
        r"\b(?:workflow|pipeline|sequence)",
    ),
}
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
AMOUNTS = (r"৳\s*[\d,]+(?:\.\d{2})?", r"\$\s*[\d,]+(?:\.\d{2})?", r"(?i)[\d,]+\s*(?:taka|dollar|bdt|usd)")
DATES = (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", rf"(?i)\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b")
REFERENCES = (r"(?i)\b(?:id|ref|reference|number|no\.?)\s*[:=]?\s*([a-z0-9-]+)\b", r"(?i)\b(?:tx|inv|lc|po|job)[-_]?\d+\b")
# kinds of entities: patterns and confidence
KINDS = {"financial_amount": (AMOUNTS, 0.95), "date": (DATES, 0.9), "reference_id": (REFERENCES, 0.95)}
RANGES = (r"(?i)\bbetween\s+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+and\s+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(?i)\bfrom\s+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+to\s+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})")
LIMITS = (
    (r"(?i)\bgreater\s+than\s+([\d,]+(?:\.\d{2})?)", "greater_than"),
    (r"(?i)\bless\s+than\s+([\d,]+(?:\.\d{2})?)", "less_than"),
    (r"(?i)\babove\s+([\d,]+(?:\.\d{2})?)", "greater_than"),
    (r"(?i)\bbelow\s+([\d,]+(?:\.\d{2})?)", "less_than"),
    (r">\s*([\d,]+(?:\.\d{2})?)", "greater_than"),
    (r"<\s*([\d,]+(?:\.\d{2})?)", "less_than"),
)
DEPARTMENT = r"(?i)\b(?:in|from|for|by)\s+(commercial|accounting|marketing|production|hr|admin|maintenance)\s+(?:department|dept)?"
TIMES = (
    r"(?i)\b(?:last|previous)\s+(?:week|month|quarter|year)",
    r"(?i)\b(?:this|current)\s+(?:week|month|quarter|year)",
    r"(?i)\b(?:next|upcoming)\s+(?:week|month|quarter|year)",
    r"(?i)\byesterday\b",
    r"(?i)\btoday\b",
    r"(?i)\btomorrow\b",
    rf"(?i)\b(?:{_MONTHS})\s+\d{{4}}",
    r"(?i)\bq[1-4]\s+\d{4}",
    r"\b\d{4}\b",
)
SYNONYMS = {
    "customer": ("client", "buyer", "company", "firm"),
    "machine": ("equipment", "unit", "device"),
    "MHM": ("embroidery machine", "printing machine", "textile machine"),
    "expense": ("cost", "expenditure", "spending", "outlay"),
    "revenue": ("income", "earning", "sales", "turnover"),
    "order": ("purchase order", "PO", "requisition", "request"),
    "LC": ("letter of credit", "documentary credit", "trade finance"),
}
CONTEXTS = {
    "accounting": (("cost", "expense", "revenue", "profit", "budget", "payment", "invoice"), ("financial_report", "invoice", "payment_receipt")),
    "production": (("machine", "MHM", "production", "manufacturing", "capacity", "output"), ("production_schedule", "machine_log", "quality_report")),
    "commercial": (("customer", "order", "LC", "export", "shipment", "commercial"), ("export_order", "lc_document", "commercial_invoice")),
    "hr_admin": (("salary", "employee", "staff", "payroll", "attendance"), ("salary_sheet", "attendance_report", "hr_record")),
}
PROCESSES = {
    "order_management": ("order", "purchase", "requisition", "PO"),
    "financial_processing": ("payment", "invoice", "expense", "revenue"),
    "production_planning": ("schedule", "capacity", "machine", "production"),
    "export_operations": ("LC", "export", "shipment", "commercial"),
    "hr_management": ("salary", "payroll", "employee", "staff"),
}
SCOPES = {
    "historical": ("historical", "past", "previous", "last year", "last quarter"),
    "current": ("current", "now", "today", "this month", "this quarter"),
    "future": ("future", "upcoming", "planned", "next month", "next quarter"),
}
SENSITIVITY = {"high": ("salary", "confidential", "private", "sensitive"), "low": ("public", "general", "overview")}
PERIODS = {"last_quarter": ("last quarter", "previous quarter"), "current_quarter": ("this quarter", "current quarter"), "last_month": ("last month", "previous month")}
# patterns that are screened together, in the order of their bits
INTENT_PATTERNS = tuple(p for patterns in INTENTS.values() for p in patterns)
ENTITY_PATTERNS = tuple(p for patterns, _ in KINDS.values() for p in patterns)
CONSTRAINT_PATTERNS = (*RANGES, *[p for p, _ in LIMITS], DEPARTMENT)


def cleaned(questions: DataFrame, text: str = "question") -> DataFrame:
    """SC-20: with a column ``cleaned``: stripped and lower-cased, the rewrites in their order, white space squeezed. Capitals
    that a rewrite brings in are in no word of a later one. Each rewrite is a step of its own, which reads the text before it once."""
    out, x = questions.withColumn("cleaned", F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))), F.col("cleaned")
    for pattern, to in REWRITES:
        out = out.withColumn("cleaned", F.when(may_hold(x, pattern), F.regexp_replace(x, f"(?i){pattern}", to)).otherwise(x))
    return out.withColumn("cleaned", F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ | $", ""))


def scores(cleaned: Column, bits: Column) -> list[Column]:
    """SC-21: a score for each intent. A pattern counts 1, or 2 if it has the word "specific" in it, over the number of the
    intent's patterns. ``bits``: which of ``INTENT_PATTERNS`` may match."""
    out, k = [], 0
    for patterns in INTENTS.values():
        hits = F.lit(0.0)
        for p in patterns:
            hits += F.when(is_set(bits, k) & cleaned.rlike(f"(?i){p}"), 2.0 if "specific" in p else 1.0).otherwise(0.0)
            k += 1
        out.append(hits / len(patterns))
    return out


def intents(scored: list[Column]) -> Column:
    """SC-21: structs of score, place and name of the intents with a hit, best first, the first defined on ties."""
    one = [F.when(s > 0, F.struct(s.alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("name"))) for k, (s, name) in enumerate(zip(scored, INTENTS))]
    return F.sort_array(F.array_compact(F.array(*one)), asc=False)


def primary(ranked: Column) -> Column:
    return F.coalesce(F.get(ranked, F.lit(0))["name"], F.lit("unknown"))


def primary_score(ranked: Column) -> Column:
    return F.coalesce(F.get(ranked, F.lit(0))["score"], F.lit(0.0))


def secondary(ranked: Column) -> Column:
    """Further intents above 0.3 and above half the first one's score."""
    rest = F.slice(ranked, F.lit(2), F.greatest(F.size(ranked) - 1, F.lit(0)))
    return F.transform(F.filter(rest, lambda s: (s["score"] > 0.3) & (s["score"] > primary_score(ranked) * 0.5)), lambda s: s["name"])


def _each(values: Column, of, kind: str) -> Column:
    """``of`` each value; most texts have none."""
    return F.when(F.size(values) == 0, F.array().cast(f"array<struct<{kind}>>")).otherwise(F.transform(values, of))


def entity_values(cleaned: Column, bits: Column) -> dict[str, Column]:
    """SC-23: what the texts hold of each kind of ``KINDS``, pattern by pattern. ``bits``: which of ``ENTITY_PATTERNS`` may match."""
    out, k = {}, 0
    for kind, (patterns, _) in KINDS.items():
        out[kind] = F.concat(*[matches(cleaned, p, 0, is_set(bits, k + j)) for j, p in enumerate(patterns)])
        k += len(patterns)
    return out


def entities(values: dict[str, Column]) -> Column:
    """SC-23: structs of kind, value and confidence."""

    def of(kind: str, confidence: float) -> Column:
        return _each(values[kind], lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(confidence).alias("confidence")), "kind:string,value:string,confidence:double")

    return F.concat(*[of(kind, confidence) for kind, (_, confidence) in KINDS.items()])


def named_entities(text: Column, known: dict[str, tuple[str, ...]]) -> Column:
    """SC-22, JN-12: structs of kind, value, confidence and context of the known names a text holds, kind by kind. A name in
    the text and known has 0.7 + 0.2 + 0.2, at most 1; the context is three words before and after the first word that
    holds it, null for names of several words."""
    low, words = F.lower(text), F.split(text, r"\s+")
    names = [(kind, name) for kind, values in known.items() for name in values]

    def entity(kind: str, name: str) -> Column:
        at = F.array_position(F.transform(words, lambda w: F.contains(F.lower(w), F.lit(name.lower()))), F.lit(True)).cast("int")
        start = F.greatest(at - 3, F.lit(1))
        context = F.when(at > 0, F.array_join(F.slice(words, start, at + 4 - start), " "))
        return F.when(F.contains(low, F.lit(name.lower())), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("value"), F.lit(1.0).alias("confidence"), context.alias("context")))

    return F.array_compact(F.array(*[entity(*n) for n in names]))


def constraint_values(cleaned: Column, bits: Column) -> list[Column]:
    """SC-24: values of the date ranges, of the limits of amounts pattern by pattern, and of departments. ``bits``: which of
    ``CONSTRAINT_PATTERNS`` may match."""
    group = lambda p, k: F.regexp_extract_all(cleaned, F.lit(p), F.lit(k))
    pairs = [F.when(~is_set(bits, k), F.array().cast("array<string>")).otherwise(F.zip_with(group(p, 1), group(p, 2), lambda a, b: F.concat_ws("..", a, b))) for k, p in enumerate(RANGES)]
    n = len(RANGES)
    return [F.concat(*pairs), *[matches(cleaned, p, 1, is_set(bits, n + k)) for k, p in enumerate(CONSTRAINT_PATTERNS[n:])]]


def constraints(values: list[Column]) -> Column:
    """SC-24, PF-23: structs of kind, operator and value: date ranges, limits of amounts, departments."""

    def of(kind: str, operator: str, values: Column, value=lambda v: v) -> Column:
        return _each(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(operator).alias("operator"), value(v).alias("value")), "kind:string,operator:string,value:string")

    ranges, *limits, departments = values
    parts = [of("date_range", "between", ranges)]
    parts += [of("amount", op, v, lambda v: F.replace(v, F.lit(","), F.lit(""))) for v, (_, op) in zip(limits, LIMITS)]
    return F.concat(*parts, of("department", "equals", departments, F.lower))


def _when(cond: Column, values) -> Column:
    return F.when(cond, F.array(*[F.lit(v) for v in values])).otherwise(F.array().cast("array<string>"))


def expansion(low: Column, money: Column) -> Column:
    """SC-25, SO-03: synonyms of the words, words for amounts of ``money``, and the terms of departments concerned; distinct
    and sorted."""
    words = F.split(low, " ")
    parts = [_when(F.array_contains(words, k.lower()), v) for k, v in SYNONYMS.items()]
    parts.append(_when(money, ("amount", "money", "cost", "value")))
    parts += [_when(any_of(low, terms), terms) for terms, _ in CONTEXTS.values()]
    return F.sort_array(F.array_distinct(F.concat(*parts)))


def departments(low: Column) -> Column:
    """SC-26: departments whose terms occur."""
    return F.concat(*[_when(any_of(low, terms), (name,)) for name, (terms, _) in CONTEXTS.items()])


def document_types(cleaned: Column) -> Column:
    low = F.lower(cleaned)
    return F.concat(*[_when(any_of(low, terms), kinds) for terms, kinds in CONTEXTS.values()])


def processes(cleaned: Column) -> Column:
    low = F.lower(cleaned)
    return F.concat(*[_when(any_of(low, terms), (name,)) for name, terms in PROCESSES.items()])


def complexity(intent: Column, n_entities: Column, n_constraints: Column, n_ranges: Column) -> Column:
    """SC-27: a point for over two entities, for over one constraint, for a date range; two for an analysis of money,
    comparison or trend, three for a workflow. simple, moderate from 1, complex from 2, advanced from 4."""
    points = (
        F.when(n_entities > 2, 1).otherwise(0)
        + F.when(n_constraints > 1, 1).otherwise(0)
        + F.when(intent.isin("analysis_comparison", "analysis_trend", "analysis_financial"), 2).otherwise(0)
        + F.when(intent == "operational_workflow", 3).otherwise(0)
        + F.when(n_ranges > 0, 1).otherwise(0)
    )
    return F.when(points >= 4, "advanced").when(points >= 2, "complex").when(points >= 1, "moderate").otherwise("simple")


def suggested(context_departments: Column, money: Column) -> Column:
    """SC-28: the context's departments and accounting where there is an amount; distinct and sorted."""
    return F.sort_array(F.array_union(context_departments, _when(money, ("accounting",))))


def time_references(cleaned: Column, bits: Column) -> Column:
    """SC-29: pattern by pattern. ``bits``: which of ``TIMES`` may match."""
    return F.concat(*[matches(cleaned, p, 0, is_set(bits, k)) for k, p in enumerate(TIMES)])


def periods(references: Column) -> Column:
    """SC-29: the periods that references name, by either spelling, in the references' order."""

    def of(ref: Column) -> Column:
        out = None
        for name, words in PERIODS.items():
            hit = F.lower(ref).isin(*words)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return F.array_compact(F.transform(references, of))


def confidence(intent_score: Column, found_entities: Column, found_constraints: Column) -> Column:
    """AG-40, AG-41: 0.4 intent + 0.3 entities + 0.3 constraints. Entities: their mean confidence and 0.1 of the share of those
    of high value, at most 1; 0.3 without any. Constraints: the mean of 0.5 + 0.3 (amount, date range) + 0.2 (a known
    operator) + 0.1, at most 1 each; 0.7 without any."""
    mean = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x)) / F.size(a)
    valued = F.size(F.filter(found_entities, lambda e: e["kind"].isin("customers", "staff_members", "financial_amount", "reference_id")))
    of_entities = F.when(F.size(found_entities) == 0, 0.3).otherwise(F.least(F.lit(1.0), mean(found_entities, lambda e: e["confidence"]) + 0.1 * (valued / F.size(found_entities))))
    one = lambda c: F.least(F.lit(1.0), 0.8 + F.when(c["kind"].isin("amount", "date_range"), 0.3).otherwise(0.0))
    of_constraints = F.when(F.size(found_constraints) == 0, 0.7).otherwise(mean(found_constraints, one))
    return intent_score * 0.4 + of_entities * 0.3 + of_constraints * 0.3


def completeness(intent_score: Column, n_entities: Column, n_constraints: Column, n_expansion: Column, n_departments: Column, n_times: Column) -> Column:
    """AG-40: 0.25, 0.15 or 0.05 for the intent; 0.2 entities, 0.15 constraints, 0.15 context, 0.1 expansion, 0.1 departments,
    0.05 times."""
    share = lambda n, v: F.when(n > 0, v).otherwise(0.0)
    first = F.when(intent_score > 0.7, 0.25).when(intent_score > 0.4, 0.15).otherwise(0.05)
    return first + share(n_entities, 0.2) + share(n_constraints, 0.15) + 0.15 + share(n_expansion, 0.1) + share(n_departments, 0.1) + share(n_times, 0.05)
