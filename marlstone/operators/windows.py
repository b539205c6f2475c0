"""SC-76, SC-77, SC-79: context windows by priority tiers, what is refused is compressed, and the window as text.

Chunks are rows of a query: pos (their order), kind, level (1 critical to 4 low), relevance, text, strategy, tokens. A query has
as many as its search returned, so a window's chunks are one array, and a fold carries the budget through the tiers. Forms of a
chunk: ``whole``, ``light`` (sentences, 0.75), ``hard`` (lines, 0.6), ``dense`` (by its strategy, 0.6). A form has its share of
the chunk's tokens: those of its text by those of the whole text, cut to a whole number; an empty text keeps its number.

Null texts are empty, null relevance is 0, null tokens are 0; equal relevance is in the order of pos. A query without chunks has
no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import structured_token_estimate
from marlstone.operators.compression import _B, _HEAD, _IMP, _LINES, _S, _STRATEGY, _SUM, _WEIGHT, chunk_strategy, compressed, main_lines, summarised
from marlstone.operators.search import ENTITIES
from marlstone.session import table

# What looks like tables, lists, objects, numbered lists and numbers of keys; section titles by kind.
STRUCTURED = (r"\|.*\|", r"^\s*[-*+]\s+", r'\{\s*".*?"\s*:', r"^\s*\d+\.\s+", r":\s*\$?\d+")
TITLES = {"query": "=== USER QUERY ===", "business_context": "=== BUSINESS CONTEXT ===", "document": "=== RELEVANT DOCUMENTS ===", "metadata": "=== ADDITIONAL CONTEXT ==="}
SUMMARY = "=== CONTEXT SUMMARY ==="
#: Share of the budget from which a window is optimised.
FILLED = 0.8
KEPT = "array<struct<pos:int,tokens:int,form:string>>"


def structured(text: Column) -> Column:
    """Whether a text looks like a table, a list or an object."""
    out = F.lit(False)
    for p in STRUCTURED:
        out = out | text.rlike("(?m)" + p)
    return out


def _shrunk(tokens: Column, text: Column, form: Column) -> Column:
    share = F.when(form == "", 0).otherwise(structured_token_estimate(form)) / structured_token_estimate(text)
    return F.when(text == "", tokens).otherwise(F.floor(tokens * share).cast("int"))


def with_forms(chunks: DataFrame, keep=()) -> DataFrame:
    """``chunks`` with the forms ``light``, ``hard`` and ``dense`` and the tokens of each. Critical chunks have no dense form."""
    rows = chunks.withColumns({"text": F.coalesce("text", F.lit("")), "relevance": F.coalesce("relevance", F.lit(0.0)), "tokens": F.coalesce("tokens", F.lit(0)).cast("int")})
    text = F.col("text")
    exact = F.col("strategy").isNull() | (F.col("strategy") == "preserve_exact")
    to = F.when(exact & structured(text), "compress_structured").when(exact, "summarize_semantic").otherwise(F.col("strategy"))
    rows = rows.withColumns({"light": summarised(text, 0.75, keep), "hard": main_lines(text, 0.6), "dense": compressed(text, to, 0.6, keep)})
    return rows.withColumns({f"{f}_tokens": _shrunk(F.col("tokens"), text, F.col(f)) for f in ("light", "hard", "dense")})


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x["tokens"])


def _kept(items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(x["pos"].alias("pos"), x["tokens"].alias("tokens"), x["form"].alias("form")))


def _fill(items: Column, firm: Column, budget: Column) -> Column:
    """``firm`` whatever it costs, then each of ``items`` that still fits; one that doesn't is passed over."""
    start = F.struct(_kept(firm).cast(KEPT).alias("kept"), _total(firm).alias("used"))

    def add(s: Column, x: Column) -> Column:
        taken = F.struct(F.array_append(s["kept"], F.struct(x["pos"], x["tokens"], x["form"])).cast(KEPT).alias("kept"), (s["used"] + x["tokens"]).alias("used"))
        return F.when(s["used"] + x["tokens"] <= budget, taken).otherwise(s)

    return F.aggregate(items, start, add, lambda s: s["kept"])


def _in_form(chunks: Column, form) -> Column:
    """Chunks as items of level, order by relevance, pos, tokens and form; ``form`` gives tokens and name of a chunk's form."""

    def item(c: Column) -> Column:
        tokens, name = form(c)
        return F.struct(c["level"].alias("level"), (-c["relevance"]).alias("order"), c["pos"].alias("pos"), tokens.alias("tokens"), name.alias("form"), c["has_light"].alias("has_light"), c["hard_tokens"].alias("hard_tokens"))

    return F.transform(chunks, item)


def optimised(chunks: DataFrame, by: list[str], budget: int, strategy: Column, keep=()) -> DataFrame:
    """SC-76, SC-77: the window of each query (``by``): its chunks with ``place`` (null if left out), ``form`` and ``used_tokens``,
    and the query's ``original_tokens`` and ``compression_applied``.

    A window within the budget and at most ``FILLED`` of it stays whole. conservative: critical and high chunks whatever they cost,
    then the medium ones that fit; low ones are left out. aggressive: all but critical chunks are dense; if that is too much,
    by level and relevance those that fit. balanced (also any other name): medium and low chunks of over 300 characters are light;
    if that is too much, the other medium ones are hard; if that still is, low ones are left out, critical and high ones stay and
    medium ones are taken by relevance while they fit."""
    rows = with_forms(chunks, keep)
    fields = ["pos", "level", "relevance", "tokens", "light_tokens", "hard_tokens", "dense_tokens"]
    has_light = (F.col("level") >= 3) & (F.length("text") > 300)
    other = [c for c in rows.columns if c not in by]
    each = F.struct(*[F.col(c) for c in fields], has_light.alias("has_light"), F.struct(*[F.col(c) for c in other if c not in fields]).alias("rest"))
    windows = rows.groupBy(*by).agg(F.sort_array(F.collect_list(each)).alias("c"), F.first(strategy).alias("_strategy"))
    limit, c = F.lit(budget), F.col("c")
    whole = lambda x: (x["tokens"], F.lit("whole"))
    windows = windows.withColumns(
        {
            "_whole": _in_form(c, whole),
            "_dense": _in_form(c, lambda x: (F.when(x["level"] == 1, x["tokens"]).otherwise(x["dense_tokens"]), F.when(x["level"] == 1, "whole").otherwise("dense"))),
            "_light": _in_form(c, lambda x: (F.when(x["has_light"], x["light_tokens"]).otherwise(x["tokens"]), F.when(x["has_light"], "light").otherwise("whole"))),
        }
    )

    def harder(x: Column) -> Column:
        hard = (x["level"] == 3) & ~x["has_light"]
        return F.struct(x["level"].alias("level"), x["order"].alias("order"), x["pos"].alias("pos"), F.when(hard, x["hard_tokens"]).otherwise(x["tokens"]).alias("tokens"), F.when(hard, "hard").otherwise(x["form"]).alias("form"))

    windows = windows.withColumn("_hard", F.transform("_light", harder))
    firm = lambda x: x["level"] <= 2
    medium = lambda x: x["level"] == 3
    conservative = _fill(F.filter("_whole", medium), F.filter("_whole", firm), limit)
    aggressive = F.when(_total(F.col("_dense")) <= limit, _kept(F.col("_dense"))).otherwise(_fill(F.sort_array("_dense"), F.filter("_dense", lambda x: F.lit(False)), limit))
    balanced = (
        F.when(_total(F.col("_light")) <= limit, _kept(F.col("_light")))
        .when(_total(F.col("_hard")) <= limit, _kept(F.col("_hard")))
        .otherwise(_fill(F.sort_array(F.filter("_hard", medium)), F.filter("_hard", firm), limit))
    )
    total = _total(F.col("_whole"))
    enough = (total <= limit) & (total / limit * 100 <= FILLED * 100)
    windows = windows.withColumn("original_tokens", total).withColumn("_fits", enough)
    windows = windows.withColumn("_kept", F.when(F.col("_fits"), _kept(F.col("_whole"))).when(F.col("_strategy") == "conservative", conservative).when(F.col("_strategy") == "aggressive", aggressive).otherwise(balanced))
    squeezed = F.exists("_kept", lambda k: k["form"] != "whole")
    applied = ~F.col("_fits") & F.when(F.col("_strategy") == "conservative", False).when(F.col("_strategy") == "aggressive", True).otherwise(squeezed)
    windows = windows.withColumn("compression_applied", applied).withColumn("_places", F.transform("_kept", lambda k: k["pos"]))

    def placed(x: Column) -> Column:
        at = F.array_position("_places", x["pos"])
        return F.struct(x.alias("x"), F.when(at > 0, at).cast("int").alias("place"), F.get(F.col("_kept"), (at - 1).cast("int")).alias("k"))

    out = windows.select(*by, "original_tokens", "compression_applied", F.inline(F.transform("c", placed)))
    names = [*[F.col(f"x.{f}").alias(f) for f in fields], *[F.col(f"x.rest.{f}").alias(f) for f in other if f not in fields]]
    return out.select(*by, *names, "place", F.when(F.col("place").isNotNull(), F.col("k.form")).alias("form"), F.when(F.col("place").isNotNull(), F.col("k.tokens")).alias("used_tokens"), "original_tokens", "compression_applied")


def form_text() -> Column:
    """The text of a chunk in its form."""
    form = F.col("form")
    return F.when(form == "light", F.col("light")).when(form == "hard", F.col("hard")).when(form == "dense", F.col("dense")).otherwise(F.col("text"))


def summary(windows: DataFrame, by: list[str], budget: int) -> DataFrame:
    """SC-77: a query's original and final tokens, their ratio, chunks that are in, compressed and left out, utilisation in
    percent and quality (0.4 for a critical chunk, 0.3 for a high one, 0.2 of the mean relevance)."""
    inside = F.col("place").isNotNull()
    final, n = F.coalesce(F.sum("used_tokens"), F.lit(0)), F.count_if(inside)
    has = lambda level: F.when(F.max(F.when(inside, (F.col("level") == level).cast("int"))) == 1, 1.0).otherwise(0.0)
    quality = F.when(n == 0, 0.0).otherwise(0.4 * has(1) + 0.3 * has(2) + 0.2 * F.avg(F.when(inside, F.col("relevance"))))
    original = F.max("original_tokens")
    return windows.groupBy(*by).agg(
        original.alias("original_tokens"), final.alias("final_tokens"), F.when(original > 0, final / original).otherwise(1.0).alias("ratio"), n.alias("included"),
        F.count_if(inside & (F.col("form") != "whole")).alias("compressed"), F.count_if(~inside).alias("excluded"), (final / budget * 100).alias("utilisation"), quality.alias("quality"),
        F.max("compression_applied").alias("compression_applied"),
    )


def _of_kind(kind: str) -> Column:
    return F.filter("c", lambda x: x["kind"] == kind)


def formatted(windows: DataFrame, by: list[str], budget: int) -> DataFrame:
    """SC-79: the window as text: a section for each kind that is there, documents under numbered headers (columns document and
    department, where there are any), and a summary."""
    named = [F.col(c) if c in windows.columns else F.lit(None).cast("string").alias(c) for c in ("document", "department")]
    rows = windows.select(*by, "kind", "place", "form", "used_tokens", "compression_applied", form_text().alias("t"), *named)
    inside = F.when(F.col("place").isNotNull(), F.struct("place", "kind", "t", "document", "department", "form"))
    got = rows.groupBy(*by).agg(
        F.sort_array(F.collect_list(inside)).alias("c"), F.sum("used_tokens").alias("used"), F.count_if(F.col("place").isNull()).alias("over"), F.max("compression_applied").alias("applied")
    )
    lines = []
    for kind, title in TITLES.items():
        of_kind = _of_kind(kind)
        if kind == "document":

            def body(x: Column, i: Column) -> Column:
                ref = F.when(x["document"].isNotNull(), F.concat(F.lit(" (ID: "), F.substring(x["document"], 1, 8), F.lit("...)"))).otherwise("")
                home = F.when(x["department"].isNotNull(), F.concat(F.lit(" - "), F.initcap(x["department"]), F.lit(" Department"))).otherwise("")
                return F.concat(F.lit("--- Document "), (i + 1).cast("string"), ref, home, F.lit(" ---\n"), x["t"], F.lit("\n"))

            texts = F.array_join(F.transform(of_kind, body), "\n")
        else:
            texts = F.concat(F.array_join(F.transform(of_kind, lambda x: x["t"]), "\n"), F.lit("\n"))
        lines.append(F.when(F.size(of_kind) > 0, F.concat(F.lit(title + "\n"), texts)))
    squeezed = F.size(F.filter("c", lambda x: x["form"] != "whole"))
    lines += [
        F.lit(SUMMARY),
        F.concat(F.lit("Total Context Chunks: "), F.size("c").cast("string")),
        F.concat(F.lit("Token Utilization: "), F.format_string("%.1f", F.coalesce("used", F.lit(0)) / budget * 100), F.lit("%")),
        F.when(F.col("applied"), F.concat(F.lit("Compressed Chunks: "), squeezed.cast("string"))),
        F.when(F.col("over") > 0, F.concat(F.lit("Additional Documents Available: "), F.col("over").cast("string"))),
    ]
    return got.select(*by, F.array_join(F.array_compact(F.array(*lines)), "\n").alias("context"))


BUDGET = 700


def _turn_chunks(s: SparkSession, d: str) -> DataFrame:
    """Turns as the chunks of their conversation: the first is the question, longer ones matter more."""
    n = F.length("text")
    level = F.when(F.col("turn") == 0, 1).when(n > 600, 2).when(n > 200, 3).otherwise(4)
    kind = F.when(F.col("turn") == 0, "query").when(F.col("role") == "user", "metadata").otherwise("document")
    return table(s, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), kind.alias("kind"), level.alias("level"), (n % 10 / 10).alias("relevance"), "text", chunk_strategy(F.col("text")).alias("strategy"), structured_token_estimate(F.col("text")).alias("tokens"))


def _windows(s: SparkSession, d: str, strategy: str, budget: int = BUDGET) -> DataFrame:
    return optimised(_turn_chunks(s, d), ["conv_id"], budget, F.lit(strategy), ENTITIES)


def _rows(strategy: str):
    return lambda s, d: _windows(s, d, strategy).select("conv_id", "pos", "place", "form", "used_tokens", "original_tokens", "compression_applied")


def _summaries(s: SparkSession, d: str) -> DataFrame:
    found = summary(_windows(s, d, "balanced"), ["conv_id"], BUDGET)
    return found.withColumns({c: F.round(c, 6) for c in ("ratio", "utilisation", "quality")})


QUERIES = {
    "sc76_conservative": _rows("conservative"),
    "sc76_aggressive": _rows("aggressive"),
    "sc76_balanced": _rows("balanced"),
    "sc77_prepared": _summaries,
    "sc79_sections": lambda s, d: formatted(_windows(s, d, "conservative"), ["conv_id"], BUDGET),
}


def _estimate(t: str) -> str:
    n = f"CAST(floor(length({t}) * 0.7::DOUBLE) AS INT)"
    n = f"CASE WHEN regexp_matches({t}, '[|{{]') THEN CAST(floor({n} * 0.8::DOUBLE) AS INT) ELSE {n} END"
    return f"greatest(1, CASE WHEN regexp_matches({t}, '[A-Z][a-z]+ [A-Z][a-z]+|[0-9]{{3,}}|[$]') THEN CAST(floor(({n}) * 1.1::DOUBLE) AS INT) ELSE {n} END)"


def _less(form: str) -> str:
    return f"CASE WHEN body = '' THEN tokens ELSE CAST(floor(tokens * (CASE WHEN {form} = '' THEN 0 ELSE {_estimate(form)} END / {_estimate('body')}::DOUBLE)) AS INT) END"


_SQL_STRUCTURED = " OR ".join(f"regexp_matches(body, '(?m){p}')" for p in STRUCTURED)
_TO = f"CASE WHEN strategy <> 'preserve_exact' THEN strategy WHEN {_SQL_STRUCTURED} THEN 'compress_structured' ELSE 'summarize_semantic' END"
_SUM6, _LINES6 = _SUM.replace("0.7::DOUBLE", "0.6::DOUBLE"), _LINES.replace("0.7::DOUBLE", "0.6::DOUBLE")
_FORMS = f"""RECURSIVE t AS (SELECT conv_id, turn AS pos, role, coalesce(text, '') AS body FROM conversations), u AS (SELECT *, {_S} AS s, string_split(body, chr(10)) AS ls, {_STRATEGY} AS strategy, {_estimate('body')} AS tokens,
  CASE WHEN pos = 0 THEN 1 WHEN length(body) > 600 THEN 2 WHEN length(body) > 200 THEN 3 ELSE 4 END AS level, length(body) % 10 / 10::DOUBLE AS relevance FROM t),
 w AS (SELECT *, list_transform(s, lambda x, i: {{'score': {_IMP}, 'i': i, 's': x}}) AS scored, list_filter(list_transform(ls, lambda x, i: {{'score': {_WEIGHT}, 'i': i, 's': x}}), lambda z: z.score > 0) AS weighed, {_TO} AS towards FROM u),
 f AS (SELECT *, {_SUM.replace('0.7::DOUBLE', '0.75::DOUBLE')} AS light, {_LINES6} AS hard, CASE towards WHEN 'summarize_semantic' THEN {_SUM6} ELSE {_LINES6} END AS dense FROM w),
 g AS (SELECT *, {_less('light')} AS light_tokens, {_less('hard')} AS hard_tokens, {_less('dense')} AS dense_tokens, level >= 3 AND length(body) > 300 AS has_light FROM f),
 h AS (SELECT *, CASE WHEN has_light THEN light_tokens ELSE tokens END AS t1, CASE WHEN has_light THEN light_tokens WHEN level = 3 THEN hard_tokens ELSE tokens END AS t3, CASE WHEN level = 1 THEN tokens ELSE dense_tokens END AS td FROM g),
 q AS (SELECT *, CAST(sum(tokens) OVER c AS INT) AS original, sum(t1) OVER c AS s1, sum(t3) OVER c AS s3, sum(td) OVER c AS sd FROM h WINDOW c AS (PARTITION BY conv_id)),
 p AS (SELECT *, original <= {BUDGET} AND original / {BUDGET}::DOUBLE * 100 <= 80 AS fits FROM q)"""
#: By strategy: when all chunks stay, tokens and form then, which are firm, which follow, their tokens, form and order.
_RULES = {
    "conservative": ("fits", "tokens", "'whole'", "level <= 2", "level = 3", "tokens", "'whole'", "pos", "false"),
    "aggressive": (f"fits OR sd <= {BUDGET}", "CASE WHEN fits THEN tokens ELSE td END", "CASE WHEN fits OR level = 1 THEN 'whole' ELSE 'dense' END", "false", "true", "td", "CASE WHEN level = 1 THEN 'whole' ELSE 'dense' END", "level, relevance DESC, pos", "NOT fits"),
    "balanced": (
        f"fits OR s1 <= {BUDGET} OR s3 <= {BUDGET}", f"CASE WHEN fits THEN tokens WHEN s1 <= {BUDGET} THEN t1 ELSE t3 END",
        f"CASE WHEN fits THEN 'whole' WHEN has_light THEN 'light' WHEN s1 > {BUDGET} AND level = 3 THEN 'hard' ELSE 'whole' END",
        "level <= 2", "level = 3", "t3", "CASE WHEN has_light THEN 'light' WHEN level = 3 THEN 'hard' ELSE 'whole' END", "relevance DESC, pos", "bool_or(form <> 'whole') OVER (PARTITION BY conv_id) AND NOT fits",
    ),
}


def _windows_sql(strategy: str) -> str:
    """A recursive fold: rows of a window in their order, each with the tokens used before it."""
    all_in, all_tokens, all_form, firm, follow, tokens, form, order, applied = _RULES[strategy]
    return f"""WITH {_FORMS}, o AS (SELECT *, {all_in} AS stays, {all_tokens} AS all_tokens, {all_form} AS all_form, {firm} AS firm, {follow} AS follows, {tokens} AS cost, {form} AS cost_form, row_number() OVER (PARTITION BY conv_id, {firm}, {follow} ORDER BY {order}) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS j FROM p),
 b AS (SELECT conv_id, coalesce(CAST(sum(cost) FILTER (firm) AS BIGINT), 0) AS firm_cost, count(*) FILTER (firm) AS firm_n FROM o GROUP BY conv_id),
 r AS (SELECT conv_id, 0::BIGINT AS i, firm_cost AS used, firm_n AS n, false AS took FROM b UNION ALL
  SELECT r.conv_id, o.i, CASE WHEN r.used + o.cost <= {BUDGET} THEN r.used + o.cost ELSE r.used END, CASE WHEN r.used + o.cost <= {BUDGET} THEN r.n + 1 ELSE r.n END, r.used + o.cost <= {BUDGET} FROM r JOIN o ON o.conv_id = r.conv_id AND o.follows AND NOT o.stays AND o.i = r.i + 1),
 k AS (SELECT o.*, CASE WHEN o.stays THEN j WHEN firm THEN row_number() OVER (PARTITION BY o.conv_id, firm ORDER BY pos) WHEN r.took THEN r.n END AS place FROM o LEFT JOIN r ON r.conv_id = o.conv_id AND o.follows AND r.i = o.i),
 z AS (SELECT *, CASE WHEN place IS NULL THEN NULL WHEN stays THEN all_form WHEN firm THEN 'whole' ELSE cost_form END AS form, CASE WHEN place IS NULL THEN NULL WHEN stays THEN all_tokens WHEN firm THEN tokens ELSE cost END AS used_tokens FROM k),
 done AS (SELECT *, coalesce({applied}, false) AS compression_applied FROM z) """


_LABEL = f"SELECT conv_id, pos, place, form, body, CASE WHEN pos = 0 THEN 'query' WHEN role = 'user' THEN 'metadata' ELSE 'document' END AS kind, used_tokens FROM done"
_ROWS_SQL = "SELECT conv_id, CAST(pos AS INT) AS pos, CAST(place AS INT) AS place, form, CAST(used_tokens AS INT) AS used_tokens, original AS original_tokens, compression_applied FROM done"
ORACLE_SQL = {f"sc76_{k}": _windows_sql(k) + _ROWS_SQL for k in _RULES}
ORACLE_SQL |= {
    "sc77_prepared": _windows_sql("balanced")
    + f"""SELECT conv_id, max(original) AS original_tokens, CAST(coalesce(sum(used_tokens), 0) AS BIGINT) AS final_tokens, round(coalesce(sum(used_tokens), 0)::DOUBLE / max(original), 6) AS ratio, count(place) AS included, count(*) FILTER (form <> 'whole') AS compressed, count(*) FILTER (place IS NULL) AS excluded,
 round(coalesce(sum(used_tokens), 0)::DOUBLE / {BUDGET} * 100, 6) AS utilisation, round(CASE WHEN count(place) = 0 THEN 0 ELSE 0.4::DOUBLE * max(CASE WHEN place IS NOT NULL AND level = 1 THEN 1 ELSE 0 END) + 0.3::DOUBLE * max(CASE WHEN place IS NOT NULL AND level = 2 THEN 1 ELSE 0 END) + 0.2::DOUBLE * avg(relevance) FILTER (place IS NOT NULL) END, 6) AS quality, bool_or(compression_applied) AS compression_applied FROM done GROUP BY conv_id""",
    "sc79_sections": _windows_sql("conservative")
    + f""", l AS ({_LABEL}), m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY place) AS i FROM l WHERE place IS NOT NULL),
 x AS (SELECT conv_id, string_agg(body, chr(10) ORDER BY place) FILTER (kind = 'query') AS a, string_agg('--- Document ' || i || ' ---' || chr(10) || body || chr(10), chr(10) ORDER BY place) FILTER (kind = 'document') AS b, string_agg(body, chr(10) ORDER BY place) FILTER (kind = 'metadata') AS c, count(*) AS n, sum(used_tokens) AS used FROM m GROUP BY conv_id),
 y AS (SELECT conv_id, count(*) FILTER (place IS NULL) AS over FROM l GROUP BY conv_id)
 SELECT y.conv_id, CASE WHEN a IS NULL THEN '' ELSE '{TITLES['query']}' || chr(10) || a || chr(10) || chr(10) END || CASE WHEN b IS NULL THEN '' ELSE '{TITLES['document']}' || chr(10) || b || chr(10) END || CASE WHEN c IS NULL THEN '' ELSE '{TITLES['metadata']}' || chr(10) || c || chr(10) || chr(10) END
 || '{SUMMARY}' || chr(10) || 'Total Context Chunks: ' || coalesce(n, 0) || chr(10) || 'Token Utilization: ' || printf('%.1f', coalesce(used, 0)::DOUBLE / {BUDGET} * 100) || '%' || CASE WHEN y.over > 0 THEN chr(10) || 'Additional Documents Available: ' || y.over ELSE '' END AS context FROM y LEFT JOIN x ON x.conv_id = y.conv_id""",
}
