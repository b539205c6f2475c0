"""Typing of documents and files by word lists: classes, letters of credit, quality, priority, department, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.understanding import CATEGORIES
from marlstone.plans.samples import ASKED_SQL, any_of, any_sql, asked, cases, cases_sql, count_of, count_sql, text_sql
from marlstone.session import table

# The rule tables of the file and text classes.
FILE_PRIORITY = {"urgent": ("cash", "urgent", "due", "payment"), "high": ("salary", "order", "customer", "lc")}
FILE_DEPARTMENT = {"accounting": ("cash", "payment", "expense", "financial"), "production": ("production", "machine", "schedule"), "commercial": ("order", "customer", "export", "commercial"), "hr_admin": ("salary", "hr", "employee", "staff")}
PDF_PRIORITY = {"urgent": ("lc", "letter of credit", "urgent"), "high": ("invoice", "payment", "order")}
PDF_DEPARTMENT = {"commercial": ("commercial", "export", "lc"), "accounting": ("account", "financial", "payment"), "production": ("production", "manufacturing")}
CONTRACT_WORDS = ("agreement", "contract", "terms and conditions", "party", "whereas")
CREDIT_TERMS = ("letter of credit", "documentary credit", "issuing bank", "beneficiary", "applicant")
BANK_TERMS = ("issuing bank", "advising bank", "confirming bank", "beneficiary", "applicant")
CREDIT_NUMBERS = (r"lc\s*(?:no|number)?\s*:?\s*[a-zA-Z0-9/-]+", r"credit\s*(?:no|number)\s*:?\s*[a-zA-Z0-9/-]+", r"documentary\s*credit\s*(?:no|number)\s*:?\s*[a-zA-Z0-9/-]+")
CURRENCY = (r"(?:usd|eur|gbp|bdt)\s*[\d,]+\.?\d*", r"[\d,]+\.?\d*\s*(?:usd|eur|gbp|bdt|dollars?|euros?|pounds?|taka)")
CREDIT_FILE = {"lc": 0.4, "letter of credit": 0.5, "documentary credit": 0.2, "export": 0.2, "amendment": 0.3}
PDF_WORDS = ("customer", "amount", "date", "invoice", "order", "payment")
CUSTOMER_WORDS = ("ltd", "limited", "knit", "textile", "fashion", "apparel")
CATEGORY_RANK = {"lc": 1, "finance": 2, "invoice": 3, "hr": 4, "inventory": 5, "reports": 6, "unknown": 8}
#: Keyword lists of the text classes: (weight, words) and the file name's words; parameters of ``text_class``.
CLASSES = {
    "lc": (((0.3, ("letter of credit", "documentary credit", "lc")), (0.1, ("issuing bank", "advising bank", "beneficiary", "applicant"))), ("lc", "letter", "credit")),
    "invoice": (((0.3, ("invoice", "bill", "receipt")), (0.1, ("amount due", "payment terms", "subtotal", "tax"))), ("invoice", "bill", "receipt")),
    "report": (((0.3, ("balance", "profit and loss", "financial statement", "revenue", "expense")), (0.1, ("month", "quarter", "annual", "year"))), ("report", "statement", "summary")),
    "contract": (((0.2, CONTRACT_WORDS),), ()),
}


def text_class(text: Column, file: Column, classes: dict = CLASSES) -> Column:
    """SC-100: struct of class and confidence. A class scores its words by weight and 0.2 for its words in the file's name, at
    most 1; the greatest wins, the first on ties; below 0.3, or without a text, it is unknown with 0."""
    low, name = F.lower(text), F.lower(file)
    scored = []
    for k, (kind, (groups, file_words)) in enumerate(classes.items()):
        score = sum((count_of(low, words) * F.lit(w) for w, words in groups), F.lit(0.0))
        if file_words:
            score = score + F.when(any_of(name, file_words), 0.2).otherwise(0.0)
        scored.append(F.struct(F.round(F.least(F.lit(1.0), score), 6).alias("confidence"), F.lit(-k).alias("place"), F.lit(kind).alias("class")))
    best = F.array_max(F.array(*scored))
    good = (F.length(text) > 0) & (best["confidence"] >= 0.3)
    return F.struct(F.when(good, best["class"]).otherwise("unknown").alias("class"), F.when(good, best["confidence"]).otherwise(0.0).alias("confidence"))


def credit_confidence(text: Column, file: Column, secondary=("advising bank", "expiry", "amendment"), shipping=("bill of lading", "shipment", "port")) -> Column:
    """SC-102: by terms 0.3, 0.5, 0.7; secondary and shipping words 0.05 each, at most 0.3 and 0.2; the file's name at most 0.6;
    0.1 for a number, 0.2 for three bank terms, 0.05 for a currency; at most 1. Above 0.5 it is one."""
    low, name = F.lower(text), F.lower(file)
    n = count_of(low, CREDIT_TERMS)
    any_match = lambda patterns: F.exists(F.array(*[low.rlike(p) for p in patterns]), lambda x: x)
    score = (
        F.when(n >= 3, 0.7).when(n >= 2, 0.5).when(n >= 1, 0.3).otherwise(0.0)
        + F.least(F.lit(0.3), count_of(low, secondary) * 0.05)
        + F.least(F.lit(0.2), count_of(low, shipping) * 0.05)
        + F.least(F.lit(0.6), sum((F.when(F.contains(name, F.lit(k)), v).otherwise(0.0) for k, v in CREDIT_FILE.items()), F.lit(0.0)))
        + F.when(any_match(CREDIT_NUMBERS), 0.1).otherwise(0.0)
        + F.when(count_of(low, BANK_TERMS) >= 3, 0.2).otherwise(0.0)
        + F.when(any_match(CURRENCY), 0.05).otherwise(0.0)
    )
    return F.when(F.length(text) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 6))


def pdf_quality(text: Column, pages: Column, page_count: Column) -> Column:
    """SC-104: 0.4 of length / 1000 (over 100 characters, at most 1), 0.3 of the pages read, 0.3 of the words found."""
    extraction = F.when(F.length(text) > 100, F.least(F.lit(1.0), F.length(text) / 1000)).otherwise(0.0)
    complete = F.when(pages > 0, pages / page_count).otherwise(0.0)
    return extraction * 0.4 + complete * 0.3 + count_of(F.lower(text), PDF_WORDS) / len(PDF_WORDS) * 0.3


def likely_customer(value: Column) -> Column:
    """SC-95."""
    return any_of(F.lower(value), CUSTOMER_WORDS)


def likely_staff(value: Column) -> Column:
    """SC-95: one to three words that all begin with a capital and go on in small letters, without a digit."""
    return value.rlike(r"^\s*[A-Z][a-z]*(?:[^A-Za-z0-9]+[A-Z][a-z]*)*[^A-Za-z0-9]*$") & (F.size(F.filter(F.split(value, r"\s+"), lambda w: w != "")) <= 3)


def category_priority(category: Column, is_excel: Column) -> Column:
    """TK-11: the category's rank, one better for spreadsheets, 1 at best."""
    rank = F.coalesce(F.get(F.array(*[F.lit(v) for v in CATEGORY_RANK.values()]), F.array_position(F.array(*[F.lit(k) for k in CATEGORY_RANK]), category).cast("int") - 1), F.lit(8))
    return F.when(is_excel, F.greatest(F.lit(1), rank - 1)).otherwise(rank)


def exact_lookup(value: Column, known: dict[str, str]) -> Column:
    """JN-19: exact match or null."""
    out = None
    for key, to in known.items():
        out = F.when(value == key, to) if out is None else out.when(value == key, to)
    return out


def to_analyse(inventory: DataFrame, prefix: str, force: bool = False) -> DataFrame:
    """SRC-31: files below ``prefix`` that are pending, failed or to be done again (all if ``force``), by priority and age."""
    rows = inventory.filter(F.col("file_path").startswith(prefix))
    if not force:
        rows = rows.filter(F.col("status").isin("pending", "failed", "needs_reprocessing"))
    return rows.orderBy("priority", "created_at", "file_path")


def standard_terms(text: Column, variations: dict[str, tuple[str, ...]]) -> Column:
    """SC-92: whole-word variations become the standard term, in order, whatever their case."""
    out = text
    for standard, words in variations.items():
        for w in words:
            out = F.regexp_replace(out, rf"(?i)\b{w}\b", standard)
    return out


def percentages(text: Column) -> Column:
    """SC-92: the percentages of a text, two decimals."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1)), lambda v: F.round(v.cast("double"), 2))


def quantities(text: Column) -> Column:
    """SC-92: numbers with a unit, as ``value unit``."""
    p = F.lit(r"(?i)([0-9,]+)\s*(dozen|pieces|units|pcs)")
    return F.zip_with(F.regexp_extract_all(text, p, F.lit(1)), F.regexp_extract_all(text, p, F.lit(2)), lambda v, u: F.concat_ws(" ", F.replace(v, F.lit(","), F.lit("")), F.lower(u)))


TERMS = {"Letter of Credit": ("lc", "l/c"), "invoice": ("bill", "inv"), "machine": ("equipment",)}
FOLDERS = {"Accounts": "Accounting", "Hr": "HR", "Plant": "Maintenance"}

def _events(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).select("event_id", "ts", F.col("question").alias("text"), "file")


def _sc99(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("file")
    return _events(s, d).select(
        "event_id", cases(low, FILE_PRIORITY, "medium").alias("priority"), cases(low, FILE_DEPARTMENT, F.lit(None)).alias("department"), cases(low, PDF_PRIORITY, "medium").alias("pdf_priority"), cases(low, PDF_DEPARTMENT, F.lit(None)).alias("pdf_department")
    )


def _inventory(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "completed", "failed", "needs_reprocessing")]), (k % 4 + 1).cast("int"))
    return _events(s, d).select(F.concat_ws("#", "file", k.cast("string")).alias("file_path"), status.alias("status"), (k % 8 + 1).alias("priority"), F.col("ts").alias("created_at"))


QUERIES = {
    "sc100_text_class": lambda s, d: _events(s, d).select("event_id", text_class(F.col("text"), F.col("file")).alias("c")).select("event_id", "c.class", "c.confidence"),
    "sc102_credit": lambda s, d: _events(s, d).withColumn("confidence", credit_confidence(F.col("text"), F.col("file"))).select("event_id", "confidence", (F.col("confidence") > 0.5).alias("is_credit")),
    "sc104_pdf_quality": lambda s, d: table(s, d, "documents").select("doc_id", F.round(pdf_quality(F.coalesce("text", F.lit("")), F.col("doc_id") % 5, F.col("doc_id") % 5 + 1), 6).alias("quality")),
    "sc99_file_rules": _sc99,
    "sc95_likely_names": lambda s, d: table(s, d, "customer").select("c_custkey", likely_customer(F.concat_ws(" ", "c_name", F.when(F.col("c_custkey") % 3 == 0, "Ltd"))).alias("customer"), likely_staff(F.when(F.col("c_custkey") % 2 == 0, F.initcap("c_mktsegment")).otherwise(F.col("c_name"))).alias("staff")),
    "tk11_priority": lambda s, d: _events(s, d).select("event_id", category_priority(cases(F.lower("text"), CATEGORIES, "unknown"), F.endswith("file", F.lit(".xlsx"))).alias("priority")),
    "jn19_folders": lambda s, d: _events(s, d).select("event_id", exact_lookup(F.get(F.split("file", "/"), F.lit(0)), FOLDERS).alias("department")),
    "src31_inventory": lambda s, d: to_analyse(_inventory(s, d), "Accounts").select("file_path", "status", "priority"),
    "sc92_terms": lambda s, d: _events(s, d).select("event_id", standard_terms(F.col("text"), TERMS).alias("standard"), F.array_join(F.transform(percentages(F.col("text")), lambda v: F.round(v * 100).cast("long").cast("string")), ",").alias("percent_hundredths"), F.array_join(quantities(F.col("text")), ",").alias("quantities")),
}
_E = f"(SELECT event_id, ts, question AS text, lower(question) AS low, file, lower(file) AS name FROM ({ASKED_SQL}))"


def _class_sql() -> str:
    one = []
    for k, (kind, (groups, file_words)) in enumerate(CLASSES.items()):
        score = " + ".join(f"{count_sql('low', words)} * {w}::DOUBLE" for w, words in groups)
        if file_words:
            score += f" + CASE WHEN {any_sql('name', file_words)} THEN 0.2::DOUBLE ELSE 0 END"
        one.append(f"{{'confidence': round(least(1::DOUBLE, {score}), 6), 'place': {-k}, 'class': {text_sql(kind)}}}")
    return f"list_max([{', '.join(one)}])"


_ANY = lambda ps: "(" + " OR ".join(f"regexp_matches(low, {text_sql(p)})" for p in ps) + ")"
_CREDIT = f"""CASE WHEN text = '' THEN 0::DOUBLE ELSE round(least(1::DOUBLE, CASE WHEN {count_sql('low', CREDIT_TERMS)} >= 3 THEN 0.7::DOUBLE WHEN {count_sql('low', CREDIT_TERMS)} >= 2 THEN 0.5::DOUBLE WHEN {count_sql('low', CREDIT_TERMS)} >= 1 THEN 0.3::DOUBLE ELSE 0 END
 + least(0.3::DOUBLE, {count_sql('low', ('advising bank', 'expiry', 'amendment'))} * 0.05::DOUBLE) + least(0.2::DOUBLE, {count_sql('low', ('bill of lading', 'shipment', 'port'))} * 0.05::DOUBLE)
 + least(0.6::DOUBLE, {' + '.join(f"CASE WHEN contains(name, {text_sql(k)}) THEN {v}::DOUBLE ELSE 0 END" for k, v in CREDIT_FILE.items())})
 + CASE WHEN {_ANY(CREDIT_NUMBERS)} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {count_sql('low', BANK_TERMS)} >= 3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {_ANY(CURRENCY)} THEN 0.05::DOUBLE ELSE 0 END), 6) END"""
_STANDARD = "text"
for _to, _words in TERMS.items():
    for _w in _words:
        _pattern = "(?i)\\b" + _w + "\\b"
        _STANDARD = f"regexp_replace({_STANDARD}, {text_sql(_pattern)}, {text_sql(_to)}, 'g')"
_Q = "'(?i)([0-9,]+)\\s*(dozen|pieces|units|pcs)'"
ORACLE_SQL = {
    "sc100_text_class": f"SELECT event_id, CASE WHEN text <> '' AND b.confidence >= 0.3 THEN b.class ELSE 'unknown' END AS class, CASE WHEN text <> '' AND b.confidence >= 0.3 THEN b.confidence ELSE 0 END AS confidence FROM (SELECT *, {_class_sql()} AS b FROM {_E})",
    "sc102_credit": f"SELECT event_id, c AS confidence, c > 0.5 AS is_credit FROM (SELECT *, {_CREDIT} AS c FROM {_E})",
    "sc104_pdf_quality": f"SELECT doc_id, round(CASE WHEN length(body) > 100 THEN least(1::DOUBLE, length(body) / 1000::DOUBLE) ELSE 0 END * 0.4::DOUBLE + (doc_id % 5) / (doc_id % 5 + 1)::DOUBLE * 0.3::DOUBLE + {count_sql("lower(body)", PDF_WORDS)} / 6::DOUBLE * 0.3::DOUBLE, 6) AS quality FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)",
    "sc99_file_rules": f"SELECT event_id, {cases_sql('name', FILE_PRIORITY, text_sql('medium'))} AS priority, {cases_sql('name', FILE_DEPARTMENT, 'NULL')} AS department, {cases_sql('name', PDF_PRIORITY, text_sql('medium'))} AS pdf_priority, {cases_sql('name', PDF_DEPARTMENT, 'NULL')} AS pdf_department FROM {_E}",
    "sc95_likely_names": "SELECT c_custkey, c_custkey % 3 = 0 AS customer, c_custkey % 2 = 0 AS staff FROM customer",
    "tk11_priority": f"SELECT event_id, CASE WHEN ends_with(file, '.xlsx') THEN greatest(1, r - 1) ELSE r END AS priority FROM (SELECT event_id, file, CASE {cases_sql('low', CATEGORIES, text_sql('unknown'))} {' '.join(f'WHEN {text_sql(k)} THEN {v}' for k, v in CATEGORY_RANK.items())} ELSE 8 END AS r FROM {_E})",
    "jn19_folders": f"SELECT event_id, CASE string_split(file, '/')[1] {' '.join(f'WHEN {text_sql(k)} THEN {text_sql(v)}' for k, v in FOLDERS.items())} END AS department FROM {_E}",
    "src31_inventory": f"SELECT file || '#' || event_id AS file_path, ['pending', 'completed', 'failed', 'needs_reprocessing'][CAST(event_id % 4 + 1 AS INT)] AS status, event_id % 8 + 1 AS priority FROM {_E} WHERE starts_with(file, 'Accounts') AND event_id % 4 <> 1",
    "sc92_terms": f"SELECT event_id, {_STANDARD} AS standard, array_to_string(list_transform(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), lambda v: CAST(CAST(round(round(v::DOUBLE, 2) * 100) AS BIGINT) AS VARCHAR)), ',') AS percent_hundredths, array_to_string(list_transform(list_zip(regexp_extract_all(text, {_Q}, 1), regexp_extract_all(text, {_Q}, 2)), lambda z: replace(z[1], ',', '') || ' ' || lower(z[2])), ',') AS quantities FROM {_E}",
}
