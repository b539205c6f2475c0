"""The texts, questions and files that the rule queries read from the given tables, and rule tables as SQL."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table

#: Orders in words: by priority what is asked, with the order's own numbers and dates ({key}, {customer}, {price}, {day}, {later}).
SENTENCES = {
    "1-URGENT": "What is the total cost of order PO-{key} for the accounting department between {day} and {later}? Please compare revenue versus expense above {price} BDT",
    "2-HIGH": "Show me the specific invoice number INV-{key} for Larkfield Textile Ltd. Amount due {price} BDT by {later}. Payment terms 30 days!",
    "3-MEDIUM": "how has production output changed over time, last quarter? Machine 7 ran {customer}% of the shift since {day}. Output was {key} pieces and 40 dozen, cost: ${price}.",
    "4-NOT SPECIFIED": "Tell me about the payroll process for staff members: salary sheet of {day}, ref: A-{key}, less than ${price}",
    "5-LOW": "can you find all documents of the LC shipment planned for next month? Letter of credit no: LC-{key} from the issuing bank to the beneficiary, USD {price}, status {customer}",
}
#: Files by the state of an order, and by its priority where it is finished.
FILES_BY_STATUS = {"O": "Plant/machine schedule {key}.csv", "P": "Sales/export order {key}.docx"}
FILES_BY_PRIORITY = {
    "1-URGENT": "Commercial/urgent payment due {key}.xlsx", "2-HIGH": "Accounts/invoice {key}.pdf", "3-MEDIUM": "Accounts/cash book {customer}.xlsx",
    "4-NOT SPECIFIED": "Hr/salary sheet {key}.xlsx", "5-LOW": "Larkfield/LC amendment {customer}.pdf",
}
DEPARTMENT_BY_STATUS = {"F": "production", "O": "accounting", "P": "commercial"}
_PIECES = {
    "key": (lambda: F.col("o_orderkey").cast("string"), "CAST(o_orderkey AS VARCHAR)"),
    "customer": (lambda: F.col("o_custkey").cast("string"), "CAST(o_custkey AS VARCHAR)"),
    "price": (lambda: F.floor("o_totalprice").cast("string"), "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"),
    "day": (lambda: F.date_format("o_orderdate", "dd/MM/yyyy"), "strftime(o_orderdate, '%d/%m/%Y')"),
    "later": (lambda: F.date_format(F.date_add(F.to_date("o_orderdate"), 14), "dd/MM/yyyy"), "strftime(CAST(o_orderdate AS DATE) + INTERVAL 14 DAY, '%d/%m/%Y')"),
}


def _parts(template: str) -> list[tuple[str, bool]]:
    """A template's pieces in order: plain text, or the name of a value."""
    return [(p, k % 2 == 1) for k, p in enumerate(re.split(r"[{}]", template)) if p]


def _filled(template: str) -> Column:
    return F.concat(*[_PIECES[p][0]() if named else F.lit(p) for p, named in _parts(template)])


def _filled_sql(template: str) -> str:
    return " || ".join(_PIECES[p][1] if named else text_sql(p) for p, named in _parts(template))


def _by(column: str, templates: dict[str, str], otherwise: Column, fill=None) -> Column:
    out = otherwise
    for value, template in templates.items():
        out = F.when(F.col(column) == value, (fill or _filled)(template)).otherwise(out)
    return out


def asked(s: SparkSession, d: str) -> DataFrame:
    """event_id, question, department, file, ts: every turn and every document as it is, and every order in words."""
    empty = F.lit("")
    turns = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("event_id"), F.coalesce("text", empty).alias("question"), empty.alias("department"), F.concat(F.lit("Turns/"), "role", F.lit(".txt")).alias("file"), F.lit(None).cast("timestamp").alias("ts"))
    docs = table(s, d, "documents").select((F.col("doc_id") + 1_000_000_000).cast("long").alias("event_id"), F.coalesce("text", empty).alias("question"), empty.alias("department"), F.concat("source", F.lit("/"), "lang", F.lit(" text.txt")).alias("file"), F.lit(None).cast("timestamp").alias("ts"))
    orders = table(s, d, "orders").select(
        (F.col("o_orderkey") + 2_000_000_000).cast("long").alias("event_id"),
        _by("o_orderpriority", SENTENCES, empty).alias("question"),
        _by("o_orderstatus", DEPARTMENT_BY_STATUS, empty, F.lit).alias("department"),
        _by("o_orderstatus", FILES_BY_STATUS, _by("o_orderpriority", FILES_BY_PRIORITY, F.lit("Misc/notes.txt"))).alias("file"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    return turns.unionByName(docs).unionByName(orders)


def pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def list_sql(values) -> str:
    return "[" + ", ".join(map(text_sql, values)) + "]"


def pick_sql(values: tuple[str, ...], by: str) -> str:
    return f"{list_sql(values)}[CAST({by} % {len(values)} + 1 AS INT)]"


def any_of(text: Column, terms) -> Column:
    """Whether a lower-cased text holds any of the terms."""
    return reduce(Column.__or__, [F.contains(text, F.lit(t.lower())) for t in terms], F.lit(False))


def any_sql(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {text_sql(t.lower())})" for t in terms) + ")"


def count_of(text: Column, terms) -> Column:
    """How many of the terms a lower-cased text holds."""
    return reduce(Column.__add__, [F.when(F.contains(text, F.lit(t.lower())), 1).otherwise(0) for t in terms], F.lit(0))


def count_sql(text: str, terms) -> str:
    return f"len(list_filter({list_sql([t.lower() for t in terms])}, lambda t: contains({text}, t)))"


def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of a pattern holds one; empty where none are sure."""

    def of(items) -> tuple[str, ...]:
        options, run = [], ""
        for op, value in items:
            if op is _parser.LITERAL:
                run += chr(value)
                continue
            options, run = options + [(run,)], ""
            if op is _parser.SUBPATTERN:
                options.append(of(value[3]))
            elif op is _parser.BRANCH:
                parts = [of(b) for b in value[1]]
                options.append(sum(parts, ()) if all(parts) else ())
            elif op is _parser.IN and all(o is _parser.LITERAL for o, _ in value):
                options.append(tuple(chr(v) for _, v in value))
            elif op is _parser.MAX_REPEAT and value[0] > 0:
                options.append(of(value[2]))
        options = [o for o in options + [(run,)] if o and all(o)]
        return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=())

    return tuple(dict.fromkeys(x.lower() for x in of(_parser.parse(pattern))))


def may_hold(low: Column, pattern: str) -> Column:
    """False only where a pattern has no match in the text whose lower-cased form is ``low``; far cheaper than the match."""
    terms = needed(pattern)
    return any_of(low, terms) if terms else F.lit(True)


def extracted(text: Column, pattern: str, group: int, low: Column) -> Column:
    """All matches of a pattern, or of a group of it."""
    return matches(text, pattern, group, may_hold(low, pattern))


def found(text: Column, patterns, low: Column | None = None) -> Column:
    """All matches of the patterns, pattern by pattern. ``low``: the text in lower case, if there is such a column."""
    low = F.lower(text) if low is None else low
    return F.concat(*[extracted(text, p, 0, low) for p in patterns])


def screen(pattern: str) -> str:
    """A pattern in RE2's syntax, of lower-cased texts, that has a match wherever the pattern has one. Only a word boundary at
    the start is kept: letters beyond ASCII are in no word to RE2, so that one is met more often there, others might not be."""
    plain = pattern.replace("(?i)", "")
    first = r"\b" if plain.startswith(r"\b") else ""
    return first + plain.replace(r"\b", "").replace(r"\s", r"[\s\x0B]")


def screened(low: Column, patterns: tuple[str, ...]) -> Column:
    """A bit for each pattern, 63 at most, of a lower-cased text: 0 only where the pattern has no match in the text. RE2 takes one
    step a byte, whatever the pattern."""
    screens = [screen(p) for p in patterns]

    @F.arrow_udf("bigint")
    def bits(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        for k, p in enumerate(screens):
            out |= pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(zero_copy_only=False).astype(np.int64) << k
        return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))

    return bits(low)


def is_set(bits: Column, k: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0


def matches(text: Column, pattern: str, group: int, may: Column) -> Column:
    """All matches of a pattern, or of a group of it, in a text that may hold it."""
    return F.when(~may, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def found_sql(text: str, patterns) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({text}, {text_sql(p)}, 0)" for p in patterns) + ")" if len(patterns) > 1 else f"regexp_extract_all({text}, {text_sql(patterns[0])}, 0)"


def cases(value: Column, rules: dict[str, tuple[str, ...]], otherwise) -> Column:
    """The first rule any of whose terms a lower-cased text holds."""
    out = None
    for name, terms in rules.items():
        hit = any_of(value, terms)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def cases_sql(value: str, rules: dict[str, tuple[str, ...]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(value, terms)} THEN {text_sql(name)}" for name, terms in rules.items()) + f" ELSE {otherwise} END"


def _by_sql(column: str, templates: dict[str, str], otherwise: str, fill=_filled_sql) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text_sql(k)} THEN {fill(v)}" for k, v in templates.items()) + f" ELSE {otherwise} END"


ASKED_SQL = f"""SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS event_id, coalesce(text, '') AS question, '' AS department, 'Turns/' || role || '.txt' AS file, CAST(NULL AS TIMESTAMP) AS ts FROM conversations
 UNION ALL SELECT doc_id + 1000000000, coalesce(text, ''), '', source || '/' || lang || ' text.txt', NULL FROM documents
 UNION ALL SELECT o_orderkey + 2000000000, {_by_sql('o_orderpriority', SENTENCES, "''")}, {_by_sql('o_orderstatus', DEPARTMENT_BY_STATUS, "''", text_sql)},
 {_by_sql('o_orderstatus', FILES_BY_STATUS, _by_sql('o_orderpriority', FILES_BY_PRIORITY, text_sql('Misc/notes.txt')))}, CAST(o_orderdate AS TIMESTAMP) FROM orders"""
