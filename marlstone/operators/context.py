"""Context windows: token-budget folds, priorities, quality of a packed context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import token_estimate
from marlstone.session import table


def budget_fold(chunks: Column, budget: int) -> Column:
    """WN-06 over an ordered array of texts: each that still fits is taken, others are skipped; a first text beyond the budget
    is cut to max(200, 4 * budget) characters and ends the window. Struct of texts, used tokens and truncated."""
    start = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(0).alias("used"), F.lit(False).alias("truncated"))

    def add(s: Column, t: Column) -> Column:
        n = token_estimate(t)
        cut = F.substring(t, 1, max(200, 4 * budget))
        fits = s["used"] + n <= budget
        return (
            F.when(fits, F.struct(F.array_append(s["texts"], t).alias("texts"), (s["used"] + n).alias("used"), s["truncated"].alias("truncated")))
            .when((F.size(s["texts"]) == 0) & (n > budget), F.struct(F.array(cut).alias("texts"), F.lit(budget).alias("used"), F.lit(True).alias("truncated")))
            .otherwise(F.struct(s["texts"].alias("texts"), s["used"].alias("used"), F.lit(True).alias("truncated")))
        )

    return F.aggregate(chunks, start, add)


def priority_pack(chunks: Column, budget: int, shrink: float = 0.7) -> Column:
    """WN-07 over an array of (priority, pos, tokens): critical ones first, whatever they cost up to the budget, then others that
    fit, or fit at int(shrink * tokens) and are marked for compression. Array of (pos, tokens, compressed)."""
    start = F.struct(F.array().cast("array<struct<pos:int,tokens:int,compressed:boolean>>").alias("kept"), F.lit(0).alias("used"))

    def add(s: Column, c: Column) -> Column:
        small = F.floor(c["tokens"] * F.lit(shrink)).cast("int")

        def take(n: Column, compressed: bool) -> Column:
            item = F.struct(c["pos"].alias("pos"), n.alias("tokens"), F.lit(compressed).alias("compressed"))
            return F.struct(F.array_append(s["kept"], item).alias("kept"), (s["used"] + n).alias("used"))

        whole = take(c["tokens"], False)
        return F.when(s["used"] + c["tokens"] <= budget, whole).when((c["priority"] > 0) & (s["used"] + small <= budget), take(small, True)).otherwise(s)

    return F.aggregate(F.sort_array(chunks), start, add, lambda s: s["kept"])


def turns(conversations: DataFrame) -> DataFrame:
    """One row for each conversation with its texts in order. A conversation is a bounded dialogue."""
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def priority_histogram(rows: DataFrame, by: str, priority: Column) -> DataFrame:
    """AG-19: four counts, 0 where none."""
    return rows.groupBy(by).agg(*[F.count_if(priority == p).alias(p) for p in ("critical", "high", "medium", "low")])


def context_quality(rows: DataFrame, by: str, priority: Column, relevance: Column, covered: Column) -> DataFrame:
    """AG-20: 0.4 if any critical + 0.3 if any high + 0.2 mean relevance + 0.1 share of covered entities."""
    value = F.when(F.max((priority == "critical").cast("int")) == 1, 0.4).otherwise(0.0) + F.when(F.max((priority == "high").cast("int")) == 1, 0.3).otherwise(0.0)
    return rows.groupBy(by).agg(F.round(value + 0.2 * F.avg(relevance) + 0.1 * F.avg(covered.cast("int")), 6).alias("quality"))


def _priority() -> Column:
    n = F.length("text")
    return F.when(F.col("turn") == 0, "critical").when(n > 300, "high").when(n > 100, "medium").otherwise("low")


def _packed(s: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("turn") == 0, 0).otherwise(1)
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(rank.alias("priority"), F.col("turn").cast("int").alias("pos"), token_estimate(F.col("text")).alias("tokens"))).alias("c"))
    return rows.select("conv_id", F.inline(priority_pack(F.col("c"), 120)))


QUERIES = {
    "wn06_token_budget": lambda s, d: turns(table(s, d, "conversations")).select("conv_id", budget_fold(F.col("turns.text"), 100).alias("w")).select("conv_id", F.size("w.texts").alias("kept"), "w.used", "w.truncated"),
    "wn07_priority_packing": _packed,
    "ag19_priority_histogram": lambda s, d: priority_histogram(table(s, d, "conversations"), "conv_id", _priority()),
    "ag20_context_quality": lambda s, d: context_quality(table(s, d, "conversations"), "conv_id", _priority(), F.length("text") % 100 / 100, F.col("role") == "user"),
}
_PR = "CASE WHEN turn = 0 THEN 'critical' WHEN length(text) > 300 THEN 'high' WHEN length(text) > 100 THEN 'medium' ELSE 'low' END"
ORACLE_SQL = {
    "wn06_token_budget": """WITH RECURSIVE c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, greatest(1, length(text) // 4) AS n FROM conversations),
 f AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS kept, 0::BIGINT AS used, false AS truncated FROM (SELECT DISTINCT conv_id FROM c) UNION ALL
 SELECT f.conv_id, c.i, CASE WHEN used + n <= 100 THEN kept + 1 WHEN kept = 0 AND n > 100 THEN 1 ELSE kept END, CASE WHEN used + n <= 100 THEN used + n WHEN kept = 0 AND n > 100 THEN 100 ELSE used END, CASE WHEN used + n <= 100 THEN truncated ELSE true END FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
 SELECT conv_id, kept, used, truncated FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""",
    "wn07_priority_packing": """WITH RECURSIVE c AS (SELECT conv_id, CAST(turn AS INT) AS pos, CASE WHEN turn = 0 THEN 0 ELSE 1 END AS priority, CAST(greatest(1, length(text) // 4) AS INT) AS n FROM conversations),
 o AS (SELECT *, CAST(floor(n * 0.7::DOUBLE) AS INT) AS small, row_number() OVER (PARTITION BY conv_id ORDER BY priority, pos, n) AS i FROM c),
 f AS (SELECT conv_id, 0::BIGINT AS i, 0 AS used, 0 AS pos, 0 AS tokens, false AS compressed FROM (SELECT DISTINCT conv_id FROM o) UNION ALL
 SELECT f.conv_id, o.i, CASE WHEN used + n <= 120 THEN used + n WHEN priority > 0 AND used + small <= 120 THEN used + small ELSE used END, o.pos,
  CASE WHEN used + n <= 120 THEN n WHEN priority > 0 AND used + small <= 120 THEN small END, used + n > 120 FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
 SELECT conv_id, pos, tokens, compressed FROM f WHERE i > 0 AND tokens IS NOT NULL""",
    "ag19_priority_histogram": f"SELECT conv_id, " + ", ".join(f"count(*) FILTER ({_PR} = '{p}') AS {p}" for p in ("critical", "high", "medium", "low")) + " FROM conversations GROUP BY 1",
    "ag20_context_quality": f"SELECT conv_id, round(CASE WHEN bool_or({_PR} = 'critical') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN bool_or({_PR} = 'high') THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * avg(length(text) % 100 / 100) + 0.1::DOUBLE * avg(CAST(role = 'user' AS INT)), 6) AS quality FROM conversations GROUP BY 1",
}
