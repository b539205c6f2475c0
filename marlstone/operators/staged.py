"""Staged retrieval, scores of chunks and documents, sections of a text, patterns of a sheet, checks of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.operators.rerank import STRATEGIES, by_strategy, diverse, final_score, temporal_relevance
from marlstone.plans.samples import any_of, any_sql, cases, cases_sql, count_of, count_sql, pick, pick_sql, text_sql
from marlstone.session import table

# Columns that a kind of sheet requires, those it may have, and words of its file's name.
SHEET_PATTERNS = {
    "transaction_log": (("date", "amount", "description"), ("vendor", "category", "reference"), ("payment", "receipt", "transaction")),
    "employee_roster": (("name", "id", "department"), ("salary", "designation", "join_date"), ("employee", "staff", "worker")),
    "inventory_list": (("product", "quantity", "unit_cost"), ("supplier", "category", "location"), ("stock", "inventory", "product", "item")),
    "lc_register": (("lc_number", "date", "amount"), ("beneficiary", "bank", "expiry"), ("lc", "letter", "credit", "export")),
    "financial_summary": (("category", "amount"), ("period", "budget", "variance"), ("summary", "total", "balance")),
}
BLANKS = r"^\s+|\s+$"
MONEY_PATTERNS = ("transaction_log", "financial_summary")
SECTION_KINDS = {"summary_totals": ("total", "summary", "grand"), "transaction_group": ("item", "description", "particular")}


def staged_search(candidates: DataFrame, least_business: float = 0.3) -> DataFrame:
    """DR-01: the strategy's number of candidates at or above its threshold by similarity, those of enough business relevance,
    weighted scores (lookups keep their similarity and order), then a diverse selection.

    ``candidates``: query, intent, document, kind, tie, similarity, business, temporal, entity. Equal scores keep the order of
    retrieval: by similarity, tie, and the other columns where a tie comes twice, so the result doesn't depend on the order of
    the rows. A first limit that holds for every strategy is applied before the rows of a query meet."""
    most = max(s[0] for s in STRATEGIES.values())
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "tie", F.desc("business"), F.desc("temporal"), F.desc("entity"), "document", "kind")
    intent = F.col("intent")
    found = candidates.filter(F.col("similarity") >= by_strategy(intent, lambda s: F.lit(s[2])))
    found = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    found = found.filter((F.col("place") <= by_strategy(intent, lambda s: F.lit(s[0]))) & (F.col("business") >= least_business))
    score = F.when(intent == "lookup", F.col("similarity")).otherwise(final_score(intent, *map(F.col, ("similarity", "business", "temporal", "entity"))))
    found = found.withColumn("score", F.round(score, 9))
    return diverse(found, "query", [F.desc("score"), F.col("place")], ["document", "kind"], by_strategy(intent, lambda s: F.lit(s[1])))


def chunk_confidence(n_entities: Column, has_money: Column, has_time: Column) -> Column:
    """SC-108: 0.5, 0.05 for each entity (at most 0.3), 0.15 with money, 0.1 with time; 1 at most."""
    return F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.3), n_entities * 0.05) + F.when(has_money, 0.15).otherwise(0.0) + F.when(has_time, 0.1).otherwise(0.0))


def chunk_completeness(*has: Column) -> Column:
    """SC-108: 0.3 and 0.23 for each kind of facts that the chunk has; 1 at most."""
    return F.least(F.lit(1.0), 0.3 + sum((F.when(h, 0.23).otherwise(0.0) for h in has), F.lit(0.0)))


def chunk_quality(chunks: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """AG-22: of each document 0.3 mean confidence, 0.3 mean completeness, 0.2 links of all possible pairs (none with one chunk),
    0.2 share of chunks with entities. ``chunks``: by, confidence, completeness, n_entities; ``edges``: one row a link."""
    n = F.col("chunks")
    sums = chunks.groupBy(by).agg(
        F.count("*").alias("chunks"), F.avg("confidence").alias("confidence"), F.avg("completeness").alias("completeness"), F.avg((F.col("n_entities") > 0).cast("int")).alias("coverage")
    )
    both = sums.join(edges.groupBy(by).agg(F.count("*").alias("links")), by, "left").withColumn("links", F.coalesce("links", F.lit(0)))
    both = both.withColumn("density", F.when(n > 1, F.col("links") / (n * (n - 1) / 2)).otherwise(0.0))
    return both.withColumn("quality", 0.3 * F.col("confidence") + 0.3 * F.col("completeness") + 0.2 * F.col("density") + 0.2 * F.col("coverage"))


def sections(docs: DataFrame, key: str, text: str, markers) -> DataFrame:
    """SC-110: ``section`` from 0, ``name`` and ``body`` of each section of a text. A line with a marker ends the section before it
    if that has a line, and names the next; else it is a line itself. So of neighbouring marker lines every second one ends a
    section, from the first on, or from the second at the top of a text. Null texts give no section."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("marker", any_of(F.lower("line"), markers))
    lines = lines.withColumn("start", F.coalesce(F.max(F.when(~F.col("marker"), F.col("pos"))).over(w), F.lit(-1)) + 1)
    turn = (F.col("pos") - F.col("start")) % 2
    ends = F.col("marker") & (turn == F.when(F.col("start") == 0, 1).otherwise(0))
    lines = lines.withColumn("ends", ends).withColumn("section", F.sum(F.col("ends").cast("long")).over(w))
    parts = lines.groupBy(key, "section").agg(
        F.coalesce(F.max(F.when(F.col("ends"), F.regexp_replace("line", BLANKS, ""))), F.lit("Header")).alias("name"),
        F.array_sort(F.collect_list(F.when(~F.col("ends"), F.struct("pos", "line")))).alias("kept"),
    )
    return parts.filter(F.size("kept") > 0).select(key, "section", "name", F.array_join("kept.line", "\n").alias("body"))


def section_kind(name: Column) -> Column:
    """SC-110."""
    return cases(F.lower(name), SECTION_KINDS, F.lit("individual_transaction"))


def sheet_patterns(columns: Column, kinds: Column, file: Column) -> Column:
    """SC-97: the patterns above 0.4: half the share of required columns, a fifth of the share of optional ones, 0.2 for each word
    of the file's name, and 0.3, 0.2 and 0.1 for columns of money (two patterns only), dates and ids. A column counts where its
    name holds the word."""
    has = lambda word: F.exists(columns, lambda c: F.contains(F.lower(c), F.lit(word)))
    share = lambda words: sum((has(w).cast("int") for w in words), F.lit(0)) / len(words)
    held = lambda kind, weight: F.when(F.array_contains(kinds, kind), weight).otherwise(0.0)
    out = []
    for name, (required, optional, words) in SHEET_PATTERNS.items():
        score = share(required) * 0.5 + share(optional) * 0.2 + count_of(F.lower(file), words) * 0.2 + held("date", 0.2) + held("id", 0.1)
        if name in MONEY_PATTERNS:
            score = score + held("currency", 0.3)
        out.append(F.when(F.round(score, 9) > 0.4, name))
    return F.array_compact(F.array(*out))


def sheet_check(rows: Column, columns: Column, completeness: Column, patterns: Column) -> Column:
    """SC-112: struct of valid and score; a sheet without columns isn't valid, 0.2 less without rows, 0.3 less below a
    completeness of 0.5, 0.1 less without a pattern."""
    score = 1.0 - F.when(rows == 0, 0.2).otherwise(0.0) - F.when(completeness < 0.5, 0.3).otherwise(0.0) - F.when(patterns == 0, 0.1).otherwise(0.0)
    return F.struct((columns > 0).alias("valid"), F.greatest(F.lit(0.0), score).alias("score"))


def page_check(characters: Column, quality: Column, confidence: Column, pages: Column) -> Column:
    """SC-112: a document without characters isn't valid; 0.3 less below a text quality of 0.5, 0.2 less below a confidence of
    0.3, 0.1 less without a page count."""
    score = 1.0 - F.when(quality < 0.5, 0.3).otherwise(0.0) - F.when(confidence < 0.3, 0.2).otherwise(0.0) - F.when(pages == 0, 0.1).otherwise(0.0)
    return F.struct((characters > 0).alias("valid"), F.greatest(F.lit(0.0), score).alias("score"))


_NAMES, _MONEY, _TIME = ("order", "price", "team", "report"), r"\d", ("day", "month", "year", "date", "time")
_MARKERS = ("total", "item", "buyer")
_REPORTS = (
    "Item list\nBuyer: Ilmen\nyarn 20\nTotal\n900",
    "intro\nitem\ntotal\nbuyer\nlast",
    "  \n Grand total \nend\n\nItem",
    "no marker here",
    "",
    "a\nTOTAL",
)
_HEADERS = ("Date,Amount,Description,Vendor", "Name,Employee ID,Department,Salary", "Product,Quantity,Unit_Cost,Location", "LC_Number,Date,Amount,Bank", "Category,Amount,Period,Budget", "a,b", "")
_KINDS = ("date,currency", "id", "", "currency", "date,id,currency")
_SEARCHED = ("lookup", "financial", "comparison", "trend", "other")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    k, q = F.col("l_orderkey"), F.col("l_suppkey")
    return table(s, d, "lineitem").select(
        q.alias("query"), pick(_SEARCHED, q).alias("intent"), (F.col("l_partkey") % 7).alias("document"), F.col("l_returnflag").alias("kind"), (k * 10 + F.col("l_linenumber")).alias("tie"),
        (k * 31 % 1009 / 1009).alias("similarity"), (F.col("l_partkey") % 10 / 10).alias("business"), temporal_relevance(k % 400, q % 2 == 0).alias("temporal"), (F.col("l_linenumber") % 4 / 3).alias("entity"),
    )


def _turn_chunks(s: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = table(s, d, "conversations").select("conv_id", count_of(low, _NAMES).alias("n_entities"), low.rlike(_MONEY).alias("money"), any_of(low, _TIME).alias("time"))
    n, money, time = F.col("n_entities"), F.col("money"), F.col("time")
    return rows.withColumn("confidence", chunk_confidence(n, money, time)).withColumn("completeness", chunk_completeness(n > 0, money, time))


def _chunk_quality(s: SparkSession, d: str) -> DataFrame:
    out = chunk_quality(_turn_chunks(s, d), graph.QUERIES["jn14_shared_words"](s, d), "conv_id")
    return out.select("conv_id", "chunks", "links", *[F.round(c, 6).alias(c) for c in ("confidence", "completeness", "density", "coverage", "quality")])


def _sections(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text").unionByName(table(s, d, "events").select((-1 - F.col("event_id")).alias("doc_id"), pick(_REPORTS, F.col("event_id")).alias("text")))
    return sections(docs, "doc_id", "text", _MARKERS).withColumn("kind", section_kind(F.col("name")))


FILES = (
    "Larkfield/LC amendment 12.pdf", "Accounts/cash book 2024.xlsx", "Hr/salary sheet.xlsx", "Plant/machine schedule.csv", "Sales/export order 7.docx",
    "Accounts/invoice 88.pdf", "Misc/notes.txt", "Reports/monthly summary.xlsx", "Commercial/urgent payment due.xlsx", "lc/scan.pdf",
)


def _sheet_patterns(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(s, d, "events").select("event_id", F.array_join(sheet_patterns(F.split(pick(_HEADERS, k), ","), F.split(pick(_KINDS, F.floor(k / 7)), ","), pick(FILES, F.floor(k / 35))), ",").alias("patterns"))


def _checks(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(s, d, "events").select("event_id", sheet_check(k % 2, k % 3, k % 5 / 4, k % 7).alias("sheet"), page_check(k % 3, k % 5 / 4, k % 7 / 6, k % 2).alias("page"))
    return rows.select("event_id", F.col("sheet.valid").alias("sheet_valid"), F.round("sheet.score", 6).alias("sheet_score"), F.col("page.valid").alias("page_valid"), F.round("page.score", 6).alias("page_score"))


QUERIES = {
    "dr01_staged_search": lambda s, d: staged_search(_candidates(s, d)).select("query", "rank", "document", "kind", "tie", (F.round(F.col("score") * 1e6) / 1e6).alias("score")),  # as SQL rounds doubles
    "ag22_chunk_quality": _chunk_quality,
    "sc110_sections": _sections,
    "sc97_sheet_patterns": _sheet_patterns,
    "sc112_checks": _checks,
}


def _by(at: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {v[at]}" for k, v in STRATEGIES.items() if k != "default") + f" ELSE {STRATEGIES['default'][at]} END"


def _weighted() -> str:
    parts = ("similarity", "business", "temporal", "entity")
    of = lambda ws: " + ".join(f"{w}::DOUBLE * {p}" for w, p in zip(ws, parts))
    return "least(1::DOUBLE, CASE intent " + " ".join(f"WHEN '{k}' THEN {of(v[3])}" for k, v in STRATEGIES.items() if k != "default") + f" ELSE {of(STRATEGIES['default'][3])} END)"


def _pattern_sql(name: str) -> str:
    required, optional, words = SHEET_PATTERNS[name]
    share = lambda ws: "(" + " + ".join(f"CAST(list_bool_or(list_transform(cs, lambda c: contains(c, {text_sql(w)}))) AS INT)" for w in ws) + f") / {len(ws)}::DOUBLE"
    held = lambda kind, weight: f"CASE WHEN list_contains(ks, '{kind}') THEN {weight}::DOUBLE ELSE 0 END"
    score = f"{share(required)} * 0.5::DOUBLE + {share(optional)} * 0.2::DOUBLE + {count_sql('f', words)} * 0.2::DOUBLE + {held('date', 0.2)} + {held('id', 0.1)}" + (f" + {held('currency', 0.3)}" if name in MONEY_PATTERNS else "")
    return f"CASE WHEN round({score}, 9) > 0.4::DOUBLE THEN '{name}' END"


_LESS = lambda cond, by: f"CASE WHEN {cond} THEN {by}::DOUBLE ELSE 0 END"
ORACLE_SQL = {
    "dr01_staged_search": f"""WITH c AS (SELECT l_suppkey AS query, {pick_sql(_SEARCHED, 'l_suppkey')} AS intent, l_partkey % 7 AS document, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS tie,
 (l_orderkey * 31 % 1009) / 1009::DOUBLE AS similarity, (l_partkey % 10) / 10::DOUBLE AS business, CASE WHEN l_suppkey % 2 = 1 THEN 0.5::DOUBLE WHEN l_orderkey % 400 <= 30 THEN 0.9::DOUBLE WHEN l_orderkey % 400 <= 90 THEN 0.7::DOUBLE WHEN l_orderkey % 400 <= 365 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS temporal, (l_linenumber % 4) / 3::DOUBLE AS entity FROM lineitem),
 f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, tie) AS place FROM c WHERE similarity >= {_by(2)}),
 g AS (SELECT *, round(CASE WHEN intent = 'lookup' THEN similarity ELSE {_weighted()} END, 9) AS s FROM f WHERE place <= {_by(0)} AND business >= 0.3::DOUBLE),
 h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, place) AS pos, row_number() OVER (PARTITION BY query, document, kind ORDER BY s DESC, place) AS seen FROM g),
 i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS rank FROM h WHERE pos <= {_by(1)} // 2 OR seen = 1)
 SELECT query, rank, document, kind, tie, round(s, 6) AS score FROM i WHERE rank <= {_by(1)}""",
    "ag22_chunk_quality": f"""WITH e AS ({graph.ORACLE_SQL['jn14_shared_words']}), l AS (SELECT conv_id, count(*) AS links FROM e GROUP BY 1),
 t AS (SELECT conv_id, lower(coalesce(text, '')) AS low FROM conversations), f AS (SELECT conv_id, {count_sql('low', _NAMES)} AS n, regexp_matches(low, '{_MONEY}') AS money, {any_sql('low', _TIME)} AS tm FROM t),
 a AS (SELECT conv_id, count(*) AS chunks, avg(least(1::DOUBLE, 0.5::DOUBLE + least(0.3::DOUBLE, n * 0.05::DOUBLE) + {_LESS('money', 0.15)} + {_LESS('tm', 0.1)})) AS confidence,
 avg(least(1::DOUBLE, 0.3::DOUBLE + {_LESS('n > 0', 0.23)} + {_LESS('money', 0.23)} + {_LESS('tm', 0.23)})) AS completeness, avg(CAST(n > 0 AS INT)) AS coverage FROM f GROUP BY 1),
 b AS (SELECT a.*, coalesce(links, 0) AS links, CASE WHEN chunks > 1 THEN coalesce(links, 0) / (chunks * (chunks - 1) / 2::DOUBLE) ELSE 0::DOUBLE END AS density FROM a LEFT JOIN l USING (conv_id))
 SELECT conv_id, chunks, links, round(confidence, 6) AS confidence, round(completeness, 6) AS completeness, round(density, 6) AS density, round(coverage, 6) AS coverage, round(0.3::DOUBLE * confidence + 0.3::DOUBLE * completeness + 0.2::DOUBLE * density + 0.2::DOUBLE * coverage, 6) AS quality FROM b""",
    # line by line, as the rule is told, rather than by the runs of marker lines
    "sc110_sections": f"""WITH RECURSIVE t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT -1 - event_id, {pick_sql(_REPORTS, 'event_id')} FROM events),
 u AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t), v AS (SELECT doc_id, ls, list_transform(ls, lambda x: {any_sql('lower(x)', _MARKERS)}) AS ms FROM u),
 r AS (SELECT doc_id, ls, ms, 1 AS i, 0 AS section, 'Header' AS name, [ls[1]] AS held, CAST(NULL AS VARCHAR[]) AS shut, '' AS shut_name FROM v
 UNION ALL SELECT doc_id, ls, ms, i + 1, CASE WHEN ms[i + 1] AND len(held) > 0 THEN section + 1 ELSE section END, CASE WHEN ms[i + 1] AND len(held) > 0 THEN regexp_replace(ls[i + 1], {text_sql(BLANKS)}, '', 'g') ELSE name END,
 CASE WHEN ms[i + 1] AND len(held) > 0 THEN [] ELSE list_append(held, ls[i + 1]) END, CASE WHEN ms[i + 1] AND len(held) > 0 THEN held END, name FROM r WHERE i < len(ls)),
 p AS (SELECT doc_id, section - 1 AS section, shut_name AS name, shut AS held FROM r WHERE shut IS NOT NULL UNION ALL SELECT doc_id, section, name, held FROM r WHERE i = len(ls) AND len(held) > 0)
 SELECT doc_id, CAST(section AS BIGINT) AS section, name, array_to_string(held, chr(10)) AS body, {cases_sql('lower(name)', SECTION_KINDS, text_sql('individual_transaction'))} AS kind FROM p""",
    "sc97_sheet_patterns": f"WITH x AS (SELECT event_id, string_split(lower({pick_sql(_HEADERS, 'event_id')}), ',') AS cs, string_split({pick_sql(_KINDS, 'event_id // 7')}, ',') AS ks, lower({pick_sql(FILES, 'event_id // 35')}) AS f FROM events) SELECT event_id, array_to_string(list_filter([{', '.join(map(_pattern_sql, SHEET_PATTERNS))}], lambda x: x IS NOT NULL), ',') AS patterns FROM x",
    "sc112_checks": f"SELECT event_id, event_id % 3 > 0 AS sheet_valid, round(greatest(0::DOUBLE, 1 - {_LESS('event_id % 2 = 0', 0.2)} - {_LESS('event_id % 5 < 2', 0.3)} - {_LESS('event_id % 7 = 0', 0.1)}), 6) AS sheet_score, event_id % 3 > 0 AS page_valid, round(greatest(0::DOUBLE, 1 - {_LESS('event_id % 5 < 2', 0.3)} - {_LESS('event_id % 7 < 2', 0.2)} - {_LESS('event_id % 2 = 0', 0.1)}), 6) AS page_score FROM events",
}
