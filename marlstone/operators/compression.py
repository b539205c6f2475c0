"""Context chunks: what sentences, lines and entities stay, priorities, settings by question, the chunks' own texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.questions import _asked
from marlstone.operators.search import _R, ENTITIES
from marlstone.plans.samples import ASKED_SQL, asked, count_of, count_sql, found, text_sql
from marlstone.session import table

# Business words, patterns of key facts, words by intent, seasons and departments in words.
BUSINESS = ("revenue", "profit", "cost", "expense", "budget", "customer", "order", "production", "machine", "quality", "delivery", "payment", "invoice", "contract", "agreement")
FACTS = {
    "Financial": r"(?i)(?:revenue|profit|cost|expense|budget):\s*\$?[\d,]+",
    "Dates": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "Percentages": r"\d+(?:\.\d+)?%",
    "Companies": r"(?i)\b[A-Z][a-z]+ (?:Ltd|Corp|Inc|Company)\b",
    "Amounts": r"\$[\d,]+(?:\.\d{2})?",
}
INTENT_WORDS = {"analysis_financial": ("revenue", "cost", "profit", "expense", "budget"), "lookup_specific": ("id", "reference", "number", "specific"), "analysis_comparison": ("compare", "vs", "versus", "difference")}
LEVELS = {"critical": 100.0, "high": 75.0, "medium": 50.0, "low": 25.0}
SEASONS = {
    10: ("Peak Export Season (Oct-Dec)", "High activity period with maximum order fulfillment"),
    1: ("Planning Season (Jan-Mar)", "Strategic planning and budgeting period"),
    4: ("Production Ramp (Apr-Jun)", "Production scaling and capacity building"),
    7: ("Maintenance Season (Jul-Sep)", "Equipment maintenance and system upgrades"),
}
BLANK = r"^\s+|\s+$"


def sentences(text: Column) -> Column:
    """SC-72: split at marks, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda x: F.regexp_replace(x, BLANK, "")), lambda x: x != "")


def importance(sentence: Column, keep) -> Column:
    """SC-72: 10 for each name to keep, 5 for each business word, 3 for a digit, 2 less beyond 200 characters."""
    low = F.lower(sentence)
    return count_of(low, keep) * 10 + count_of(low, BUSINESS) * 5 + F.when(sentence.rlike(r"\d"), 3).otherwise(0) - F.when(F.length(sentence) > 200, 2).otherwise(0)


def _best(items: Column, n: Column, glue: str) -> Column:
    """The first ``n`` of structs (score, i, s) by score, the later one on ties, in their own order again."""
    chosen = F.slice(F.sort_array(items, asc=False), F.lit(1), n)
    return F.array_join(F.transform(F.sort_array(F.transform(chosen, lambda x: F.struct(x["i"], x["s"]))), lambda x: x["s"]), glue)


def summarised(text: Column, ratio: float, keep=()) -> Column:
    """TK-07: the most important sentences, a share of ``ratio`` and one at least."""
    parts = sentences(text)
    items = F.transform(parts, lambda s, i: F.struct(importance(s, keep).alias("score"), i.alias("i"), s.alias("s")))
    return F.when(F.size(parts) <= 1, text).otherwise(_best(items, F.greatest(F.lit(1), F.floor(F.size(parts) * ratio).cast("int")), " "))


def main_lines(text: Column, ratio: float) -> Column:
    """TK-08: headers (over two bars or tabs, capitals, the first line) weigh 100, lines with numbers ten for each, others 1;
    a share of ``ratio`` and two at least; blank lines go. Two lines or fewer stay as they are."""
    lines = F.split(text, "\n", -1)

    def item(line: Column, i: Column) -> Column:
        bare = F.regexp_replace(line, BLANK, "")
        head = (F.regexp_count(bare, F.lit("[|]")) > 2) | (F.regexp_count(bare, F.lit("\t")) > 2) | (bare.rlike(r"\p{Lu}") & ~bare.rlike(r"\p{Ll}")) | (i == 0)
        score = F.when(head, 100).when(bare.rlike(r"\d"), F.regexp_count(bare, F.lit(r"\d+")) * 10).when(bare != "", 1).otherwise(0)
        return F.struct(score.alias("score"), i.alias("i"), line.alias("s"))

    items = F.filter(F.transform(lines, item), lambda x: x["score"] > 0)
    return F.when(F.size(lines) <= 2, text).otherwise(_best(items, F.greatest(F.lit(2), F.floor(F.size(items) * ratio).cast("int")), "\n"))


def key_facts(text: Column, keep=()) -> Column:
    """SC-73: for each name to keep the first sentence that holds it, then up to three facts of each kind; where there is
    nothing, the first 200 characters."""
    parts = sentences(text)
    holding = lambda name: F.get(F.filter(parts, lambda s: F.contains(F.lower(s), F.lit(name.lower()))), F.lit(0))
    named = [holding(e) for e in keep]
    facts = []
    for name, pattern in FACTS.items():
        hits = F.slice(found(text, (pattern,)), 1, 3)
        facts.append(F.when(F.size(hits) > 0, F.concat(F.lit(f"{name}: "), F.array_join(hits, ", "))))
    lines = F.array_compact(F.array(*named, *facts))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.substring(text, 1, 200))


def chunk_priority(score: Column) -> Column:
    """SC-74."""
    return F.when(score > 0.8, "high").when(score > 0.6, "medium").otherwise("low")


def chunk_strategy(text: Column) -> Column:
    """SC-74: by length."""
    return F.when(F.length(text) > 500, "summarize_semantic").when(F.length(text) > 200, "compress_structured").otherwise("preserve_exact")


def compressed(text: Column, strategy: Column, ratio: float = 0.7, keep=()) -> Column:
    """SC-71, DR-05: by strategy."""
    return F.when(strategy == "summarize_semantic", summarised(text, ratio, keep)).when(strategy == "compress_structured", main_lines(text, ratio)).when(strategy == "extract_entities", key_facts(text, keep)).otherwise(text)


def priority_score(level: Column, relevance: Column, intent: Column, text: Column, shared: Column, in_department: Column, timed: Column) -> Column:
    """WN-08: the level's weight, 50 of relevance, 10 for each of the intent's words, 15 for each shared name, 20 for the
    department, 10 for a time."""
    base, words = F.lit(25.0), F.lit(0)
    for name, weight in LEVELS.items():
        base = F.when(level == name, weight).otherwise(base)
    for name, terms in INTENT_WORDS.items():
        words = F.when(intent == name, count_of(F.lower(text), terms)).otherwise(words)
    return base + relevance * 50.0 + words * 10.0 + shared * 15.0 + F.when(in_department, 20.0).otherwise(0.0) + F.when(timed, 10.0).otherwise(0.0)


def settings(intent: Column, complexity: Column, tokens: int = 8000, threshold: float = 0.8) -> Column:
    """SC-78: struct of most tokens, compression threshold and strategy."""
    a, k = F.contains(intent, F.lit("analysis")), F.contains(intent, F.lit("lookup"))
    most = F.when(a, min(12000, int(tokens * 1.5))).when(k, max(4000, int(tokens * 0.7))).otherwise(tokens)
    level = F.when(a, 0.9).when(k, 0.6).otherwise(threshold)
    most = F.when(complexity == "advanced", F.least(F.lit(15000), F.floor(most * 1.3))).when(complexity == "simple", F.greatest(F.lit(3000), F.floor(most * 0.6))).otherwise(most)
    return F.struct(
        most.cast("long").alias("most_tokens"), F.when(complexity == "advanced", 0.95).otherwise(level).alias("threshold"), F.when(a, "conservative").when(k, "aggressive").otherwise("balanced").alias("strategy")
    )


def season_text(month: Column) -> Column:
    """SC-75."""
    text = {k: f"Current Business Season: {a}\nDescription: {b}" for k, (a, b) in SEASONS.items()}
    return F.when(month >= 10, text[10]).when(month <= 3, text[1]).when(month <= 6, text[4]).otherwise(text[7])


def query_text(question: Column, intent: Column, complexity: Column, names: Column, departments: Column) -> Column:
    """SC-75: the question's own chunk."""
    line = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", "), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("User Query: "), question, F.lit("\nIntent: "), intent, F.lit("\nComplexity: "), complexity, F.lit("\n"), line("Key Entities: ", names), line("Relevant Departments: ", departments))


def top_counts(results: DataFrame, query: str, rank: str, facets: list[str], k: int = 5) -> DataFrame:
    """AG-21: how often each value of the facets occurs among a query's first ``k`` results."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return results.filter(F.col(rank) <= k).select(query, each.alias("e")).groupBy(query, "e.facet", "e.value").agg(F.count("*").alias("n"))


RATIO = 0.7


def _texts(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).select(F.col("event_id").alias("doc_id"), F.col("question").alias("text"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = _asked(s, d).select("event_id", "question", "intent", "complexity", "suggested", F.transform("entities", lambda e: e["value"]).alias("names"), F.col("question").alias("snippet"), (k * 7 % 11 / 10).alias("business"), (k % 12 + 1).alias("month"))
    return rows.withColumn("level", F.when(k % 9 == 0, "critical").otherwise(chunk_priority(F.col("business"))))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    rows = _chunks(s, d).withColumn("score", priority_score(F.col("level"), F.col("business"), F.col("intent"), F.col("snippet"), F.col("event_id") % 3, F.size("suggested") > 0, F.col("event_id") % 2 == 0))
    rows = rows.withColumn("q", F.col("event_id") % 50)
    return rows.select("q", "event_id", F.round("score", 6).alias("score"), F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "event_id")).alias("place"))


QUERIES = {
    "tk07_sentences": lambda s, d: _texts(s, d).select("doc_id", summarised(F.col("text"), RATIO, ENTITIES).alias("kept")),
    "tk08_lines": lambda s, d: _texts(s, d).select("doc_id", main_lines(F.col("text"), RATIO).alias("kept")),
    "sc73_key_facts": lambda s, d: _texts(s, d).select("doc_id", key_facts(F.col("text"), ENTITIES).alias("facts")),
    "sc71_compressed": lambda s, d: _texts(s, d).select("doc_id", chunk_strategy(F.col("text")).alias("strategy"), F.length(compressed(F.col("text"), chunk_strategy(F.col("text")), RATIO, ENTITIES)).alias("n")),
    "sc74_chunk_priority": lambda s, d: _chunks(s, d).select("event_id", "level"),
    "sc75_chunk_texts": lambda s, d: _chunks(s, d).select("event_id", season_text(F.col("month")).alias("season"), query_text(*map(F.col, ("question", "intent", "complexity", "names", "suggested"))).alias("query_text")),
    "sc78_settings": lambda s, d: _chunks(s, d).select("event_id", settings(F.col("intent"), F.col("complexity")).alias("s")).select("event_id", "s.most_tokens", "s.threshold", "s.strategy"),
    "wn08_priority_order": _ordered,
    "ag21_top_counts": lambda s, d: top_counts(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", ["l_returnflag", "l_linestatus"], 3),
}
_T = f"SELECT event_id AS doc_id, question AS body FROM ({ASKED_SQL})"
_S = "list_filter(list_transform(string_split_regex(body, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_IMP = f"{count_sql('lower(x)', ENTITIES)} * 10 + {count_sql('lower(x)', BUSINESS)} * 5 + CASE WHEN regexp_matches(x, '\\d') THEN 3 ELSE 0 END - CASE WHEN length(x) > 200 THEN 2 ELSE 0 END"
_PICK = lambda items, n, glue: f"array_to_string(list_transform(list_sort(list_transform(list_slice(list_reverse_sort({items}), 1, {n}), lambda z: {{'i': z.i, 's': z.s}})), lambda z: z.s), {glue})"
_B = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_HEAD = f"len(regexp_extract_all({_B}, '[|]')) > 2 OR len(regexp_extract_all({_B}, '\\t')) > 2 OR (regexp_matches({_B}, '\\p{{Lu}}') AND NOT regexp_matches({_B}, '\\p{{Ll}}')) OR i = 1"
_WEIGHT = f"CASE WHEN {_HEAD} THEN 100 WHEN regexp_matches({_B}, '\\d') THEN len(regexp_extract_all({_B}, '\\d+')) * 10 WHEN {_B} <> '' THEN 1 ELSE 0 END"
_SUM = f"CASE WHEN len(s) <= 1 THEN body ELSE {_PICK('scored', 'greatest(1, CAST(floor(len(s) * 0.7::DOUBLE) AS INT))', text_sql(' '))} END"
_LINES = f"CASE WHEN len(ls) <= 2 THEN body ELSE {_PICK('weighed', 'greatest(2, CAST(floor(len(weighed) * 0.7::DOUBLE) AS INT))', 'chr(10)')} END"
_C = f"""WITH t AS ({_T}), u AS (SELECT *, {_S} AS s, string_split(body, chr(10)) AS ls FROM t),
 w AS (SELECT *, list_transform(s, lambda x, i: {{'score': {_IMP}, 'i': i, 's': x}}) AS scored, list_filter(list_transform(ls, lambda x, i: {{'score': {_WEIGHT}, 'i': i, 's': x}}), lambda z: z.score > 0) AS weighed FROM u)
 """
_FACTS = ", ".join([f"list_filter(s, lambda x: contains(lower(x), {text_sql(e.lower())}))[1]" for e in ENTITIES] + [f"CASE WHEN regexp_matches(body, {text_sql(p)}) THEN '{n}: ' || array_to_string(regexp_extract_all(body, {text_sql(p)})[1:3], ', ') END" for n, p in FACTS.items()])
_STRATEGY = "CASE WHEN length(body) > 500 THEN 'summarize_semantic' WHEN length(body) > 200 THEN 'compress_structured' ELSE 'preserve_exact' END"
_LEVEL = "CASE WHEN event_id % 9 = 0 THEN 'critical' WHEN business > 0.8 THEN 'high' WHEN business > 0.6 THEN 'medium' ELSE 'low' END"
_SEASON = {k: f"Current Business Season: {a}\nDescription: {b}" for k, (a, b) in SEASONS.items()}
_A, _L = "contains(intent, 'analysis')", "contains(intent, 'lookup')"
_MOST = f"CASE WHEN {_A} THEN 12000 WHEN {_L} THEN 5600 ELSE 8000 END"
ORACLE_SQL = {
    "tk07_sentences": _C + f"SELECT doc_id, {_SUM} AS kept FROM w",
    "tk08_lines": _C + f"SELECT doc_id, {_LINES} AS kept FROM w",
    "sc73_key_facts": _C + f", f AS (SELECT doc_id, body, list_filter([{_FACTS}], lambda x: x IS NOT NULL) AS fs FROM w) SELECT doc_id, CASE WHEN len(fs) > 0 THEN array_to_string(fs, chr(10)) ELSE substring(body, 1, 200) END AS facts FROM f",
    "sc71_compressed": _C + f"SELECT doc_id, {_STRATEGY} AS strategy, length(CASE {_STRATEGY} WHEN 'summarize_semantic' THEN {_SUM} WHEN 'compress_structured' THEN {_LINES} ELSE body END) AS n FROM w",
    "sc74_chunk_priority": _R + f"SELECT event_id, {_LEVEL} AS level FROM r",
    "sc75_chunk_texts": _R
    + f"SELECT event_id, CASE WHEN event_id % 12 + 1 >= 10 THEN {text_sql(_SEASON[10])} WHEN event_id % 12 + 1 <= 3 THEN {text_sql(_SEASON[1])} WHEN event_id % 12 + 1 <= 6 THEN {text_sql(_SEASON[4])} ELSE {text_sql(_SEASON[7])} END AS season, 'User Query: ' || question || chr(10) || 'Intent: ' || intent || chr(10) || 'Complexity: ' || complexity || chr(10) || CASE WHEN len(entities) > 0 THEN 'Key Entities: ' || array_to_string(list_transform(entities, lambda e: regexp_replace(e, '^[a-z_]+:', '')), ', ') || chr(10) ELSE '' END || CASE WHEN len(suggested) > 0 THEN 'Relevant Departments: ' || array_to_string(suggested, ', ') || chr(10) ELSE '' END AS query_text FROM r",
    "sc78_settings": _R
    + f"SELECT event_id, CAST(CASE complexity WHEN 'advanced' THEN least(15000, floor({_MOST} * 1.3::DOUBLE)) WHEN 'simple' THEN greatest(3000, floor({_MOST} * 0.6::DOUBLE)) ELSE {_MOST} END AS BIGINT) AS most_tokens, CASE WHEN complexity = 'advanced' THEN 0.95::DOUBLE WHEN {_A} THEN 0.9::DOUBLE WHEN {_L} THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS threshold, CASE WHEN {_A} THEN 'conservative' WHEN {_L} THEN 'aggressive' ELSE 'balanced' END AS strategy FROM r",
    "wn08_priority_order": _R
    + f", x AS (SELECT event_id % 50 AS q, event_id, CASE {_LEVEL} {' '.join(f'WHEN {text_sql(k)} THEN {v}::DOUBLE' for k, v in LEVELS.items())} END + business * 50::DOUBLE + CASE intent {' '.join(f'WHEN {text_sql(k)} THEN ' + count_sql('low', v) for k, v in INTENT_WORDS.items())} ELSE 0 END * 10::DOUBLE + event_id % 3 * 15::DOUBLE + CASE WHEN len(suggested) > 0 THEN 20::DOUBLE ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 10::DOUBLE ELSE 0 END AS score FROM r) SELECT q, event_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, event_id) AS place FROM x",
    "ag21_top_counts": "SELECT l_orderkey, 'l_returnflag' AS facet, l_returnflag AS value, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL UNION ALL SELECT l_orderkey, 'l_linestatus', l_linestatus, count(*) FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL",
}
