"""Entities of texts by dictionaries and patterns: every term of every kind in one pass over a text.

Terms are found without regard to case, anywhere in a text, also within words. An Aho-Corasick automaton over all terms reads a
text once, whatever their number; it runs in an Arrow UDF that gives the numbers of the terms found, in the dictionary's order,
and the rest is expressions. The terms travel with the UDF. A dictionary above ``PART_BYTES`` is cut into parts with an
automaton each, so a task's memory is bounded by that (about 100 bytes for each byte of a part) and the result is the same.

Null and empty texts hold nothing; a term that is empty is never found; equal terms of several kinds count for each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table

PART_BYTES = 4 << 20

# The names and terms of the wide dictionary.
CUSTOMERS = (
    "RB Knit", "Blue Planet Knitwear Ltd", "Fiat Fashion Ltd", "Peak Apparels Ltd", "Sparkle Knit Composite Ltd", "Fine Tex Knitwears Ltd", "Sarah Industries",
    "Precision Textile Industry Ltd", "Orbit Fashion Ltd", "Sabah Designers Ltd", "Beximco", "Pretty Group", "Fakir Fashion Ltd", "Square Textiles",
    "DBL Group", "Envoy Textiles", "Ananta Group", "Viyellatex", "Ha-Meem Group", "Sinha Textiles", "Phoenix Group", "Noman Group",
)
STAFF = {
    "commercial": ("Mizan", "Commercial Manager", "Alamin", "Commercial Assistant"),
    "accounting": ("Nizam", "Accountant"),
    "marketing": ("Rafiq", "Marketing", "Mozammel", "Manager Marketing"),
    "production": ("Jalil", "Production Manager", "Anoweer"),
    "hr_admin": ("Ria", "Admin", "HR"),
    "maintenance": ("Babu", "Maintenance Manager"),
    "management": ("Monir Ahmed", "MD", "Tahmina Akter", "Chairman", "Shahriyar Ahmed Mahir", "Future Director"),
}
SUPPLIERS = (
    "Color supplier", "Pigment supplier", "Cable supplier", "Electrical components supplier", "Chemical supplier", "Inks supplier", "Plastisol ink supplier",
    "Water-based ink supplier", "Dyes supplier", "Fixer supplier", "Printing paste supplier", "Auxiliaries supplier", "Adhesive supplier", "Emulsion supplier",
    "Backing material supplier", "Stabilizer supplier", "Mesh supplier", "Squeegee rubber supplier", "Machine parts supplier", "Servo motor supplier",
    "Pneumatic parts supplier", "Bearings supplier", "Sensor supplier", "Maintenance service provider", "Calibration service provider", "Software supplier",
    "Design software vendor", "Automation system supplier",
)
BANKS = (
    "Sonali Bank", "Janata Bank", "Agrani Bank", "Rupali Bank", "Bangladesh Development Bank", "Pubali Bank", "United Commercial Bank", "Dutch-Bangla Bank",
    "BRAC Bank", "Prime Bank", "Eastern Bank", "City Bank", "Bank Asia", "Islami Bank Bangladesh", "Al-Arafah Islami Bank", "Mercantile Bank", "Mutual Trust Bank",
    "Standard Chartered Bangladesh", "HSBC Bangladesh", "Southeast Bank", "NRB Commercial Bank", "Midland Bank", "EXIM Bank", "One Bank",
)
MACHINES = (
    "MHM automatic screen printing machine", "Synchroprint 5000", "iQ Oval", "16-head printing machine", "Multi-head printing press", "Skin frame", "Cap frame",
    "Jacket frame", "Screen mesh", "Aluminum frame", "Mesh tensioning", "Digitizing", "Design separation", "Pattern making", "Color density control",
    "Color change unit", "Micro-registration", "Registration unit", "Backing material", "Pallet", "Pre-heat pallet", "Squeegee arm", "Flood bar",
    "Manual screen printing", "Heat press machine", "Flash dryer", "Conveyor dryer", "Blower unit", "UV curing unit", "Quality Control (QC) station",
    "Cutting machine", "Laser cutter", "Finishing equipment", "Automatic folding machine", "Packing machine",
)
MATERIALS = (
    "Skin frame", "Cap frame", "Jacket frame", "Color head", "Squeegee arm", "Squeegee carriage", "Pallet", "Pre-heat pallet", "Aluminum pallet", "Pallet indexer",
    "Registration unit", "Servo drive print head", "AC-Servo delay", "Encoder", "Sensor adapter", "Servo controller", "Touchscreen control", "Wi-Fi control",
    "Electric pallet indexer", "Base unit", "Automatic screen positioning", "MHM Automatics", "Synchroprint 5000", "iQ Oval machine", "High-speed chest printing",
)
LOCATIONS = (
    "Gazipur", "Factory", "Production floor", "Office", "Warehouse", "Storage", "Raw material store", "Finished goods store", "Packing area", "Quality lab",
    "Sample room", "Meeting room", "Canteen", "Parking",
)
# The shorter dictionary of the first matcher, and the patterns of both.
SHORT = {
    "customers": ("RB Knit", "Blue Planet Knitwear", "Fiat Fashion", "Peak Apparels", "Sparkle Knit Composite", "Fine Tex Knitwears", "Sarah Industries"),
    "staff_members": ("Mizan", "Nizam", "Alamin", "Ria", "Rafiq", "Mozammel", "Jalil", "Anoweer", "Babu", "Monir Ahmed", "Tahmina Akter"),
    "departments": ("Commercial", "Accounting", "Marketing", "Production", "HR", "Admin", "Maintenance"),
}
SHORT_AMOUNTS = (r"৳\s*[\d,]+(?:\.\d{2})?", r"\$\s*[\d,]+(?:\.\d{2})?", r"[\d,]+\s*(?:taka|dollar)")
CURRENCIES = (r"USD\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?", r"BDT\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?", r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?", r"৳\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?")
PRICES = (r"\$?\d+(?:\.\d{2})?\s*(?:per\s+)?dozen", r"(?:cheap|good|premium)\s+pricing\s+\$\d+(?:-\$?\d+)?", r"\$\d+(?:\.\d{2})?\s*-\s*\$?\d+(?:\.\d{2})?")
CAPACITIES = (
    r"(?:capacity|output|production)\s+\d+(?:,\d{3})*\s*(?:pieces?|dozens?|units?)", r"\d+\s+(?:MHM|machines?|units?|heads?)", r"\d+(?:,\d{3})*\s*stitches?",
    r"\d+\s*(?:pieces?|dozens?)\s*(?:per\s+)?hour", r"\d+\s*(?:pieces?|dozens?)\s*(?:per\s+)?day",
)
NUMBERS = {
    "lc_numbers": (r"(?:LC|L\.C\.)\s?No\.?\s?[A-Z0-9/-]+",),
    "po_numbers": (r"(?:PO|P\.O\.)\s?No\.?\s?[A-Z0-9/-]+",),
    "invoice_numbers": (r"(?:INV|Invoice)\s?No\.?\s?[A-Z0-9/-]+",),
    "orders": (r"(?:Order|WO|Work\s+Order)\s?No\.?\s?[A-Z0-9/-]+", r"(?:Job|JOB)\s?No\.?\s?[A-Z0-9/-]+"),
}
MACHINE_WORDS = (r"MHM\s+(?:embroidery\s+)?(?:machine|unit)", r"\d+\s*head\s+(?:embroidery\s+)?(?:machine|unit)", r"MHM\s+[A-Z0-9-]+", r"\b(?:dryer|cutter|press|table|frame|hoop)\b")

#: Kinds and their terms, one dictionary for all; staff terms also name their department.
WIDE = {
    "customers": CUSTOMERS,
    "suppliers": SUPPLIERS,
    "banks": BANKS,
    **{f"staff:{k}": v for k, v in STAFF.items()},
    "machines_involved": MACHINES,
    "materials": MATERIALS,
    "locations": LOCATIONS,
}
#: The keys of the wide result; the last three are never filled, as no rule gives them.
KEYS = (
    "customers", "suppliers", "banks", "staff_members", "departments_involved", "currencies", "amounts", "pricing_info", "machines_involved", "production_capacity",
    "materials", "orders", "lc_numbers", "po_numbers", "invoice_numbers", "locations", "regulatory_bodies", "dates", "certificates",
)


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...], first: int):
    """The automaton of upper-cased terms; a term's value is the numbers at which it stands in the dictionary."""
    import ahocorasick

    at: dict[str, list[int]] = {}
    for k, t in enumerate(terms):
        if t:
            at.setdefault(t.upper(), []).append(first + k)
    out = ahocorasick.Automaton()
    for t, numbers in at.items():
        out.add_word(t, tuple(numbers))
    if at:
        out.make_automaton()
    return out


def _part_udf(terms: tuple[str, ...], first: int):
    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        machine = _automaton(terms, first)
        if not len(machine):
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        out = [sorted({k for _, numbers in machine.iter(t.upper()) for k in numbers}) if t else [] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.int32()))

    return found


class TermIndex:
    """A dictionary of kinds and terms, and the expressions that find it in texts."""

    def __init__(self, dictionary: dict[str, Sequence[str]], part_bytes: int = PART_BYTES):
        self.kinds = [kind for kind, terms in dictionary.items() for _ in terms]
        self.terms = [t for terms in dictionary.values() for t in terms]
        self.parts: list[tuple[int, tuple[str, ...]]] = []
        first, size = 0, 0
        for k, t in enumerate(self.terms):
            if size and size + len(t.encode()) > part_bytes:
                self.parts.append((first, tuple(self.terms[first:k])))
                first, size = k, 0
            size += len(t.encode())
        self.parts.append((first, tuple(self.terms[first:])))

    def numbers(self, text: Column) -> Column:
        """Numbers of the terms that a text holds, ascending."""
        found = [_part_udf(terms, first)(text) for first, terms in self.parts]
        return F.concat(*found) if len(found) > 1 else found[0]

    def hits(self, numbers: Column) -> Column:
        """Those terms as an array of kind and term."""
        kinds, terms = F.array(*[F.lit(k) for k in self.kinds]), F.array(*[F.lit(t) for t in self.terms])
        return F.transform(numbers, lambda k: F.struct(F.get(kinds, k).alias("kind"), F.get(terms, k).alias("term")))


def of_kind(hits: Column, kind: str) -> Column:
    return F.transform(F.filter(hits, lambda x: x["kind"] == kind), lambda x: x["term"])


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """All that the patterns match, pattern by pattern, whatever the case, once each."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + p), F.lit(0)) for p in patterns]
    return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])


def term_rows(rows: DataFrame, index: TermIndex, text: str = "text") -> DataFrame:
    """JN-12: a row for each term that a text holds, with the columns of ``rows`` but the text."""
    other = [c for c in rows.columns if c != text]
    found = rows.select(*other, index.numbers(F.col(text)).alias("_numbers"))
    return found.select(*other, F.explode(index.hits(F.col("_numbers"))).alias("_hit")).select(*other, "_hit.kind", "_hit.term")


def short_entities(rows: DataFrame, text: str = "text") -> DataFrame:
    """SC-94: ``rows`` with customers, staff_members, departments, amounts. Machine names are not reported."""
    index = TermIndex(SHORT)
    found = rows.withColumn("_hits", index.hits(index.numbers(F.col(text))))
    return found.withColumns({**{k: of_kind(F.col("_hits"), k) for k in SHORT}, "amounts": matches(F.col(text), SHORT_AMOUNTS)}).drop("_hits")


def wide_entities(rows: DataFrame, text: str = "text") -> DataFrame:
    """SC-106: ``rows`` with an array of each of ``KEYS``, the flags and the counts."""
    index = TermIndex(WIDE)
    found = rows.withColumn("_hits", index.hits(index.numbers(F.col(text))))
    hits, whole = F.col("_hits"), F.col(text)
    staff = F.filter(hits, lambda x: F.startswith(x["kind"], F.lit("staff:")))
    money = matches(whole, CURRENCIES)
    none = F.array().cast("array<string>")
    lists = {
        **{k: of_kind(hits, k) for k in ("customers", "suppliers", "banks", "materials", "locations")},
        "staff_members": F.array_distinct(F.transform(staff, lambda x: x["term"])),
        "departments_involved": F.array_distinct(F.transform(staff, lambda x: F.substring(x["kind"], 7, 100))),
        "currencies": money,
        "amounts": money,
        "pricing_info": matches(whole, PRICES),
        "machines_involved": F.array_distinct(F.concat(of_kind(hits, "machines_involved"), matches(whole, MACHINE_WORDS))),
        "production_capacity": matches(whole, CAPACITIES),
        **{k: matches(whole, p) for k, p in NUMBERS.items()},
        **{k: none for k in ("regulatory_bodies", "dates", "certificates")},
    }
    n = {k: F.size(k) for k in KEYS}
    low = F.lower(F.coalesce(whole, F.lit("")))
    flags = {
        "has_customer_data": n["customers"] > 0,
        "has_staff_references": n["staff_members"] > 0,
        "has_production_data": (n["machines_involved"] > 0) | (n["production_capacity"] > 0),
        "has_financial_data": (n["currencies"] > 0) | (n["amounts"] > 0) | (n["pricing_info"] > 0),
        "has_cross_departmental_refs": n["departments_involved"] > 1,
        "has_mhm_machine_refs": F.exists("machines_involved", lambda x: F.contains(F.lower(x), F.lit("mhm"))),
        "has_pricing_strategy": n["pricing_info"] > 0,
        "has_gazipur_location": F.exists("locations", lambda x: F.contains(F.lower(x), F.lit("gazipur"))),
        "has_remote_management_refs": F.contains(low, F.lit("remote management")) | F.contains(low, F.lit("whatsapp")),
        "entity_count": n["customers"] + n["staff_members"] + n["machines_involved"] + n["materials"],
        "business_context_richness": sum((F.when(n[k] > 0, 1).otherwise(0) for k in ("customers", "staff_members", "machines_involved", "pricing_info")), F.lit(0)),
    }
    return found.withColumns({k: lists[k] for k in KEYS}).withColumns(flags).drop("_hits")


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Texts of documents and of turns, with their table and number."""
    docs = table(s, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    turns = table(s, d, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.unionByName(turns)


#: Beside the names, frequent short words, so that the given texts hold terms of several kinds.
COMMON = {"articles": ("the", "le", "der", "el"), "endings": ("tion", "ment", "keit", "ción"), "units": ("kg", "mg", "km")}


def _terms(s: SparkSession, d: str) -> DataFrame:
    return term_rows(_texts(s, d), TermIndex(WIDE | COMMON))


def _short(s: SparkSession, d: str) -> DataFrame:
    found = short_entities(_texts(s, d))
    return found.select("origin", "id", *[F.array_join(k, "|").alias(k) for k in (*SHORT, "amounts")])


def _wide(s: SparkSession, d: str) -> DataFrame:
    found = wide_entities(_texts(s, d))
    flags = [c for c in found.columns if c.startswith("has_")]
    return found.select("origin", "id", *[F.array_join(k, "|").alias(k) for k in KEYS], *flags, F.col("entity_count").cast("long").alias("entity_count"), F.col("business_context_richness").cast("long").alias("business_context_richness"))


QUERIES = {"jn12_terms": _terms, "sc94_entities": _short, "sc106_entities": _wide}
_TEXTS = "(SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(dictionary: dict) -> str:
    rows = [(kind, t) for kind, terms in dictionary.items() for t in terms]
    return "(VALUES " + ", ".join(f"({k}, {_quoted(kind)}, {_quoted(t)})" for k, (kind, t) in enumerate(rows)) + ") AS v(n, kind, term)"


def _held(kinds: Sequence[str], dictionary: dict) -> str:
    """The terms of some kinds that t.text holds, in the dictionary's order, as a list."""
    terms = [t for k in kinds for t in dictionary[k]]
    return f"list_filter([{', '.join(map(_quoted, terms))}], lambda x: contains(upper(coalesce(text, '')), upper(x)))"


def _found(patterns: Sequence[str]) -> str:
    return "list_concat(" * (len(patterns) - 1) + f"regexp_extract_all(coalesce(text, ''), {_quoted('(?i)' + patterns[0])})" + "".join(f", regexp_extract_all(coalesce(text, ''), {_quoted('(?i)' + p)}))" for p in patterns[1:])


def _once(x: str) -> str:
    """A list without repeats, in the order of first places."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


_STAFF = [f"staff:{k}" for k in STAFF]
_DEPARTMENTS = "list_filter([" + ", ".join(_quoted(k) for k in STAFF) + "], lambda d: " + " OR ".join(f"(d = {_quoted(k)} AND len({_held([f'staff:{k}'], WIDE)}) > 0)" for k in STAFF) + ")"
_LISTS = {
    **{k: _held([k], WIDE) for k in ("customers", "suppliers", "banks", "materials", "locations")},
    "staff_members": _held(_STAFF, WIDE),
    "departments_involved": _DEPARTMENTS,
    "currencies": _once(_found(CURRENCIES)),
    "amounts": _once(_found(CURRENCIES)),
    "pricing_info": _once(_found(PRICES)),
    "machines_involved": _once(f"list_concat({_held(['machines_involved'], WIDE)}, {_found(MACHINE_WORDS)})"),
    "production_capacity": _once(_found(CAPACITIES)),
    **{k: _once(_found(p)) for k, p in NUMBERS.items()},
    **{k: "CAST([] AS VARCHAR[])" for k in ("regulatory_bodies", "dates", "certificates")},
}
_JOINED = ", ".join(f"coalesce(array_to_string({k}, '|'), '') AS {k}" for k in KEYS)
ORACLE_SQL = {
    "jn12_terms": f"SELECT origin, id, kind, term FROM {_TEXTS} t, {_values(WIDE | COMMON)} WHERE contains(upper(coalesce(text, '')), upper(term))",
    "sc94_entities": f"SELECT origin, id, {', '.join(f'''coalesce(array_to_string({_held([k], SHORT)}, '|'), '') AS {k}''' for k in SHORT)}, coalesce(array_to_string({_once(_found(SHORT_AMOUNTS))}, '|'), '') AS amounts FROM {_TEXTS} t",
    "sc106_entities": f"""WITH l AS (SELECT origin, id, text, {', '.join(f'{x} AS {k}' for k, x in _LISTS.items())} FROM {_TEXTS} t)
 SELECT origin, id, {_JOINED}, len(customers) > 0 AS has_customer_data, len(staff_members) > 0 AS has_staff_references, len(machines_involved) + len(production_capacity) > 0 AS has_production_data,
 len(currencies) + len(pricing_info) > 0 AS has_financial_data, len(departments_involved) > 1 AS has_cross_departmental_refs, contains(lower(array_to_string(machines_involved, '|')), 'mhm') AS has_mhm_machine_refs,
 len(pricing_info) > 0 AS has_pricing_strategy, list_contains(locations, 'Gazipur') AS has_gazipur_location, contains(lower(coalesce(text, '')), 'remote management') OR contains(lower(coalesce(text, '')), 'whatsapp') AS has_remote_management_refs,
 len(customers) + len(staff_members) + len(machines_involved) + len(materials) AS entity_count,
 CAST(len(customers) > 0 AS BIGINT) + CAST(len(staff_members) > 0 AS BIGINT) + CAST(len(machines_involved) > 0 AS BIGINT) + CAST(len(pricing_info) > 0 AS BIGINT) AS business_context_richness FROM l""",
}
