"""Expressions over text: chunking folds, token estimates, numeric and time text, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """All white space at both ends, not only blanks."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def chunk_text(text: Column, most: int = 900, boundary: str = "\\n\\s*\\n", joint: str = "\n\n") -> Column:
    """SC-01: paragraphs packed greedily while the chunk stays within ``most``; a paragraph is never split; blank text gives
    one chunk, the stripped text."""
    parts = F.filter(F.transform(F.split(text, boundary), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(p) + len(joint) <= most
        return (
            F.when(s["cur"] == "", F.struct(s["done"].alias("done"), p.alias("cur")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit(joint), p).alias("cur")))
            .otherwise(F.struct(F.array_append(s["done"], s["cur"]).alias("done"), p.alias("cur")))
        )

    packed = F.aggregate(parts, empty, add, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.array_append(s["done"], s["cur"])))
    return F.when(F.size(parts) > 0, packed).otherwise(F.array(strip(text)))


def token_estimate(text: Column) -> Column:
    """SC-02: a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def structured_token_estimate(text: Column, ratio: float = 0.7) -> Column:
    """SC-70: length times ratio, less for tables, more for names, whole numbers at each step."""
    n = F.floor(F.length(text) * F.lit(ratio)).cast("int")
    table_like = text.rlike("[|{]")
    name_like = text.rlike("[A-Z][a-z]+ [A-Z][a-z]+|[0-9]{3,}|[$]")
    n = F.when(table_like, F.floor(n * F.lit(0.8)).cast("int")).otherwise(n)
    n = F.when(name_like, F.floor(n * F.lit(1.1)).cast("int")).otherwise(n)
    return F.greatest(F.lit(1), n)


def numeric_text(text: Column) -> Column:
    """PF-21: digits with optional sign, thousands commas and decimals."""
    return F.coalesce(text.rlike("^\\s*-?[0-9][0-9,]*(\\.[0-9]+)?\\s*$"), F.lit(False))


def parse_number(text: Column) -> Column:
    """SC-17: commas dropped; 0 where nothing can be read."""
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def relative_time(seconds: Column) -> Column:
    """SC-16: age in seconds to words; months have 30 days; the future is now."""

    def said(n: Column, unit: str) -> Column:
        n = n.cast("long")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, said(F.floor(seconds / 60), "minute"))
        .when(seconds < 86400, said(F.floor(seconds / 3600), "hour"))
        .when(seconds < 86400 * 30, said(F.floor(seconds / 86400), "day"))
        .otherwise(said(F.floor(seconds / (86400 * 30)), "month"))
    )


def sentences(text: Column) -> Column:
    """SC-72: split at runs of . ! ? and stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: s != "")


def select_sentences(text: Column, ratio: float = 0.5, keywords: tuple[str, ...] = ()) -> Column:
    """TK-07: the best int(n * ratio) sentences (1 at least) by importance, later ones first on ties, in text order."""

    def importance(s: Column) -> Column:
        score = F.when(s.rlike("[0-9]"), 3).otherwise(0) - F.when(F.length(s) > 200, 2).otherwise(0)
        for k in keywords:
            score = score + F.when(F.contains(F.lower(s), F.lit(k)), 5).otherwise(0)
        return score

    marked = F.transform(sentences(text), lambda s, i: F.struct(importance(s).alias("score"), i.alias("i"), s.alias("s")))
    best = F.slice(F.sort_array(marked, asc=False), F.lit(1), F.greatest(F.lit(1), F.floor(F.size(marked) * F.lit(ratio)).cast("int")))
    return F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
