"""Document typing and normalisation of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.plans.samples import cases

# Types by words of the file name, in order, then by words of the content; departments by type; categories.
TYPES_BY_NAME = {
    "proforma_invoice": ("pi", "proforma", "invoice"),
    "monthly_cash_summary": ("cash", "summary"),
    "bank_statement": ("bank", "statement"),
    "expense_report": ("expense", "expenditure"),
    "production_schedule": ("production", "schedule"),
    "machine_log": ("machine", "log"),
    "quality_report": ("quality", "qc"),
    "work_order": ("work", "order"),
    "sales_report": ("sales", "report"),
    "price_list": ("price", "list"),
    "order_confirmation": ("order", "confirmation"),
    "quotation": ("quotation", "quote"),
    "salary_sheet": ("salary", "payroll"),
    "appointment_letter": ("appointment", "joining"),
    "attendance_report": ("attendance",),
    "maintenance_log": ("maintenance", "service"),
    "utility_bill": ("utility", "electricity", "gas"),
}
TYPES_BY_CONTENT = {"machine_log": ("mhm", "embroidery", "machine"), "production_report": ("production", "capacity", "output"), "quotation": ("dozen", "pricing", "quote")}
DEPARTMENTS_BY_TYPE = {
    "accounting": ("monthly_cash_summary", "bank_statement", "expense_report", "tax_return"),
    "production": ("production_schedule", "machine_log", "work_order", "quality_report"),
    "marketing": ("sales_report", "quotation", "price_list", "customer_inquiry"),
    "hr_admin": ("salary_sheet", "appointment_letter", "attendance_report"),
    "maintenance": ("maintenance_log", "equipment_report"),
}
CATEGORIES = {
    "finance": ("payment", "budget", "transaction", "bank", "balance"),
    "lc": ("lc", "letter of credit", "shipment", "export", "import"),
    "hr": ("employee", "salary", "attendance", "hr", "leave"),
    "invoice": ("invoice", "receipt", "bill", "voucher"),
    "inventory": ("stock", "warehouse", "inventory", "store"),
}
WORDS, NUMBERS, MARKS = r"[\p{L}\p{N}_]+", r"\d+", "[.!?]"
ARTEFACTS = (r"[^\p{L}\p{N}_\s.,!?-]", r"\b[A-Za-z0-9_]{15,}\b", r"\d{10,}")


def document_type(name: Column, content: Column) -> Column:
    """SC-98: by the file's name, then by the content, else unknown."""
    return cases(F.lower(name), TYPES_BY_NAME, cases(F.lower(content), TYPES_BY_CONTENT, "unknown"))


def department_of_type(kind: Column) -> Column:
    """SC-98: commercial where no list has the type."""
    out = F.lit("commercial")
    for name, kinds in DEPARTMENTS_BY_TYPE.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def category(name: Column, content: Column, folder: Column) -> Column:
    """SC-105: by the file's name, then the content, then the folder, else unknown."""
    by_folder = cases(F.lower(folder), {"lc": ("lc",), "invoice": ("invoice",)}, "unknown")
    return cases(F.lower(name), CATEGORIES, cases(F.lower(content), CATEGORIES, by_folder))


def text_quality(text: Column) -> Column:
    """SC-101: 1 less 0.3 below 50 characters, 0.2 if fewer than two of words, numbers and marks occur over five times, 0.3 if
    a kind of artefact occurs more often than for a twentieth of the characters, 0.2 if fewer than half are letters, 0.2 if
    fewer than half of the sentences have over ten characters and a blank; 0 for no text. Struct with a label from 0.8, 0.6
    and 0.4."""
    body = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(body, F.lit(p))
    kinds = sum(((count(p) > 5).cast("int") for p in (WORDS, NUMBERS, MARKS)), F.lit(0))
    artefacts = F.exists(F.array(*[count(p) * 20 > F.length(body) for p in ARTEFACTS]), lambda x: x)
    sentences = F.split(body, "[.!?]+", -1)
    bare = F.transform(sentences, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    valid = F.size(F.filter(bare, lambda x: (F.length(x) > 10) & F.contains(x, F.lit(" "))))
    score = (
        F.lit(10)
        - F.when(F.length(body) < 50, 3).otherwise(0)
        - F.when(kinds < 2, 2).otherwise(0)
        - F.when(artefacts, 3).otherwise(0)
        - F.when(count("[a-zA-Z]") * 2 < F.length(body), 2).otherwise(0)
        - F.when(valid * 2 < F.size(sentences), 2).otherwise(0)
    )
    score = F.when(F.length(body) == 0, 0).otherwise(F.greatest(F.lit(0), score))
    label = F.when(score >= 8, "excellent").when(score >= 6, "good").when(score >= 4, "fair").otherwise("poor")
    return F.struct((score / 10).alias("score"), label.alias("label"))


def normalise_currency(text: Column) -> Column:
    """SC-90: first amount with its currency, as struct of amount and code; null where there is none."""
    number = "([0-9][0-9,]*(?:[.][0-9]+)?)"
    code_after, code_before = f"{number} ?(USD|EUR|GBP|BDT)", f"(USD|EUR|GBP|BDT) ?{number}"
    dollars = f"[$]{number}"
    value = lambda pattern, group: F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit("")).try_cast("double")
    amount = F.coalesce(value(code_after, 1), value(code_before, 2), value(dollars, 1))
    code = F.coalesce(F.nullif(F.regexp_extract(text, code_after, 2), F.lit("")), F.nullif(F.regexp_extract(text, code_before, 1), F.lit("")), F.lit("USD"))
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), code.alias("currency")))


def normalise_date(text: Column, day_first: bool = True) -> Column:
    """SC-91: ISO, day or month first with slashes, and ``April 10, 2024``; null where none fits."""
    slash = "dd/MM/yyyy" if day_first else "MM/dd/yyyy"
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, slash), F.try_to_date(text, "MMMM d, yyyy"))
