"""Answer assembly: rendered sources, context blocks and the prompt of a question with its retrieved documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.samples import ASKED_SQL, asked, text_sql
from marlstone.session import table

# The patterns of the prompt classes, their length hints and sections, limits.
ANALYTICAL = r"(?i)(analy(s|z)e|trend|compare|vs\.?|difference|delta|variance|margin|profit|efficien|utili[sz]ation|ratio|breakdown|forecast|project|estimate|calculate|calc|total|sum|average|agg(regate)?|by department|per (month|day|machine))"
LOOKUP = r"(?i)^(find|show|get|list|where|when|status|lookup|retrieve)\b"
HINTS = {
    "analytical": "Provide a thorough, structured analysis (~200–350 words) that explains the 'why', not just the number.",
    "lookup": "Give a complete, easy-to-understand answer (4–8 sentences or a short structured list) — never a single bare fragment.",
    "general": "Descriptive and complete (8–12 sentences), covering relevant context, not just the bare fact.",
}
SECTIONS = {"analytical": "Summary • Details / Findings • Calculations / Assumptions", "lookup": "Answer", "general": "Summary • Details"}
TOP, SNIPPET, CAP, MARK = 5, 900, 4000, "[Context truncated due to length limits]"
NOTHING = "No relevant documents found."
PROMPT = (
    "Business Query:\n",
    "\n\nRelevant Context:\n",
    "\n\nAnswering Directives:\n- ",
    "\n- Use Markdown where helpful (headings, bold, bullet points, small tables) —\n  never return a single flat line of text.\n- Cover: ",
    ".\n- Refer to source documents by their real name when useful; never use\n  abstract markers like [D1] or [1] — do not write your own \"Sources\" list.\n- If data is missing or ambiguous, say so and suggest the next step.\n"
    "- Do not invent figures; if you perform calculations, show only key steps and final numbers.\n\nNow provide the best possible answer in English, unless the user asks otherwise.\n",
)
SIDE = "^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$"
END = "[ \\t\\n\\x0b\\f\\r]+$"


def prompt_class(question: Column) -> Column:
    """SC-11: analytical, then lookup, else general."""
    return F.when(question.rlike(ANALYTICAL), "analytical").when(question.rlike(LOOKUP), "lookup").otherwise("general")


def source_display(name: Column, source: Column) -> Column:
    """PF-02: the file's name, with its origin if that is the remote drive."""
    return F.concat(F.coalesce(name, F.lit("Unknown Document")), F.when(source == "google_drive", " (Google Drive)").otherwise(""))


def context_text(title: Column, name: Column, department: Column, source: Column, text: Column) -> Column:
    """PF-03: a header with title (else name), department and origin, then the first 1200 characters."""
    shown = F.coalesce(F.nullif(title, F.lit("")), name, F.lit("Untitled document"))
    origin = F.when(source == "google_drive", "Google Drive").otherwise("Local")
    return F.concat(F.lit("Document: "), shown, F.lit(" | Department: "), F.coalesce(department, F.lit("General")), F.lit(" | Source: "), origin, F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 1200))


def context_block(texts: Column) -> Column:
    """SC-12: the first five texts, 900 characters of each and an ellipsis, below 4000 characters in all."""

    def one(t: Column) -> Column:
        bare = F.regexp_replace(t, SIDE, "")
        cut = F.concat(F.regexp_replace(F.substring(bare, 1, SNIPPET), END, ""), F.lit("…"))
        return F.concat(F.lit("\n---\n"), F.when(F.length(bare) > SNIPPET, cut).otherwise(bare))

    whole = F.array_join(F.concat(F.array(F.lit("Context (retrieved documents):")), F.transform(F.slice(texts, 1, TOP), one)), "\n")
    capped = F.concat(F.regexp_replace(F.substring(whole, 1, CAP - 120), END, ""), F.lit("\n\n" + MARK))
    return F.when(F.size(texts) == 0, NOTHING).when(F.length(whole) > CAP, capped).otherwise(whole)


def prompt(question: Column, context: Column) -> Column:
    """SC-13: the user's message: question, context, and what its class asks for."""
    bare = F.regexp_replace(F.coalesce(question, F.lit("")), SIDE, "")
    kind = prompt_class(bare)
    by_class = lambda values: F.when(kind == "analytical", values["analytical"]).when(kind == "lookup", values["lookup"]).otherwise(values["general"])
    a, b, c, d, e = map(F.lit, PROMPT)
    return F.concat(a, F.when(bare == "", "(empty query)").otherwise(bare), b, context, c, by_class(HINTS), d, by_class(SECTIONS), e)


def fallback_shape(rows: DataFrame) -> DataFrame:
    """PF-04: rows of the second path (text, similarity, metadata columns) in the shape of the first."""
    meta = [c for c in rows.columns if c not in ("text", "similarity")]
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("similarity").cast("double"), F.lit(0.0)).alias("score"), F.struct(*meta).alias("metadata"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(s, d, "documents").select(
        "doc_id",
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Title "), k)).alias("title"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("file"), k, F.lit(".txt"))).alias("file_name"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("source")).alias("department"),
        F.when(k % 3 == 0, "google_drive").otherwise("local").alias("source"),
        "text",
    )


def _prompts(s: SparkSession, d: str) -> DataFrame:
    """Every document's first line as the question; its context are the document's lines."""
    rows = _documents(s, d).withColumn("question", F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) > 0)
    return rows.withColumn("context", context_block(lines)).withColumn("prompt", prompt(F.col("question"), F.col("context")))


QUERIES = {
    "sc11_prompt_class": lambda s, d: asked(s, d).select("event_id", prompt_class(F.col("question")).alias("class")),
    "pf02_sources": lambda s, d: _documents(s, d).select("doc_id", source_display(F.col("file_name"), F.col("source")).alias("display")),
    "pf03_context_texts": lambda s, d: _documents(s, d).select("doc_id", context_text(*map(F.col, ("title", "file_name", "department", "source", "text"))).alias("context")),
    "pf04_fallback_shape": lambda s, d: fallback_shape(table(s, d, "documents").select("text", (F.col("doc_id") % 10 / 10).alias("similarity"), "doc_id", "lang")).select("metadata.doc_id", "metadata.lang", "score", F.length("text").alias("n")),
    "sc12_context_block": lambda s, d: _prompts(s, d).select("doc_id", "context"),
    "sc13_prompt": lambda s, d: _prompts(s, d).select("doc_id", "prompt"),
}
_SIDE, _END = text_sql(SIDE), text_sql(END)
_DOCS = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 7 <> 0 THEN 'file' || doc_id || '.txt' END AS file_name,
 CASE WHEN doc_id % 5 <> 0 THEN source END AS department, CASE WHEN doc_id % 3 = 0 THEN 'google_drive' ELSE 'local' END AS source, text FROM documents"""
_CLASS = lambda q: f"CASE WHEN regexp_matches({q}, {text_sql(ANALYTICAL)}) THEN 'analytical' WHEN regexp_matches({q}, {text_sql(LOOKUP)}) THEN 'lookup' ELSE 'general' END"
_BY = lambda v: "CASE class " + " ".join(f"WHEN {text_sql(k)} THEN {text_sql(x)}" for k, x in v.items()) + " END"
_BLOCK = f"""WITH d AS ({_DOCS}), l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS question, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) > 0) AS lines FROM d),
 w AS (SELECT *, array_to_string(list_concat(['Context (retrieved documents):'], list_transform(list_transform(lines[1:{TOP}], lambda t: regexp_replace(t, {_SIDE}, '', 'g')), lambda b: chr(10) || '---' || chr(10) || CASE WHEN length(b) > {SNIPPET} THEN regexp_replace(substring(b, 1, {SNIPPET}), {_END}, '') || '…' ELSE b END)), chr(10)) AS whole FROM l),
 c AS (SELECT doc_id, regexp_replace(question, {_SIDE}, '', 'g') AS q, CASE WHEN len(lines) = 0 THEN {text_sql(NOTHING)} WHEN length(whole) > {CAP} THEN regexp_replace(substring(whole, 1, {CAP - 120}), {_END}, '') || chr(10) || chr(10) || {text_sql(MARK)} ELSE whole END AS context FROM w)
 """
ORACLE_SQL = {
    "sc11_prompt_class": f"SELECT event_id, {_CLASS('q')} AS class FROM (SELECT event_id, question AS q FROM ({ASKED_SQL}))",
    "pf02_sources": f"SELECT doc_id, coalesce(file_name, 'Unknown Document') || CASE WHEN source = 'google_drive' THEN ' (Google Drive)' ELSE '' END AS display FROM ({_DOCS})",
    "pf03_context_texts": f"SELECT doc_id, 'Document: ' || coalesce(nullif(title, ''), file_name, 'Untitled document') || ' | Department: ' || coalesce(department, 'General') || ' | Source: ' || CASE WHEN source = 'google_drive' THEN 'Google Drive' ELSE 'Local' END || chr(10) || substring(coalesce(text, ''), 1, 1200) AS context FROM ({_DOCS})",
    "pf04_fallback_shape": "SELECT doc_id, lang, doc_id % 10 / 10::DOUBLE AS score, length(coalesce(text, '')) AS n FROM documents",
    "sc12_context_block": _BLOCK + "SELECT doc_id, context FROM c",
    "sc13_prompt": _BLOCK + f", k AS (SELECT *, {_CLASS('q')} AS class FROM c) SELECT doc_id, {text_sql(PROMPT[0])} || CASE WHEN q = '' THEN '(empty query)' ELSE q END || {text_sql(PROMPT[1])} || context || {text_sql(PROMPT[2])} || {_BY(HINTS)} || {text_sql(PROMPT[3])} || {_BY(SECTIONS)} || {text_sql(PROMPT[4])} AS prompt FROM k",
}
