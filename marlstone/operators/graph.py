"""Relationships between chunks: adjacency, shared words, shared dates, shared entities, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import table


def adjacent(chunks: DataFrame, within: list[str], order: str, key: str) -> DataFrame:
    """JN-17, WN-03: each chunk and the next."""
    nxt = F.lead(key).over(Window.partitionBy(*within).orderBy(order))
    return chunks.select(*within, F.col(key).alias("source_id"), nxt.alias("target_id")).filter("target_id is not null")


# Fixed value: sets of up to so many terms travel with each of their terms, and pairs of them are verified where they meet.
WIDE = 32


def shared_terms(rows: DataFrame, within: list[str], key: str, terms: str, floor: float, denominator: str = "min") -> DataFrame:
    """JN-13 to JN-16: pairs a < b in the same ``within`` whose sets of terms overlap by more than ``floor`` of the smaller set
    (``min``) or of both (``union``). A pair above the floor shares one of the smaller set's rarest terms, so only those meet
    the other sets: a term that a third of all rows hold comes last and is hardly ever joined. A pair is verified where it meets
    first, at the rarest term it shares, and moves no more; where the larger set has over ``WIDE`` terms, pairs meet without
    their sets, count once and are joined with them."""
    each = rows.select(*within, F.col(key).alias("k"), F.explode(F.array_distinct(terms)).alias("term"))
    common = each.groupBy(*within, "term").agg(F.count("*").alias("df"))
    sets = each.join(common, [*within, "term"]).groupBy(*within, "k").agg(F.sort_array(F.collect_list(F.struct("df", "term")))["term"].alias("t"))
    n = F.size("t")
    rare = F.slice("t", F.lit(1), n - F.floor(n * F.lit(floor)).cast("int"))
    narrow, smaller = n <= WIDE, "na < nb or (na = nb and a < b)"
    shared = F.size(F.array_intersect("ta", "tb"))
    base = F.least(F.size("ta"), F.size("tb")) if denominator == "min" else F.size("ta") + F.size("tb") - shared

    def small(of: DataFrame, *more) -> DataFrame:
        return of.select(*within, F.col("k").alias("a"), n.alias("na"), *more, F.explode(rare).alias("term"))

    def large(of: DataFrame, *more) -> DataFrame:
        return of.select(*within, F.col("k").alias("b"), n.alias("nb"), *more, F.explode("t").alias("term"))

    met = small(sets.filter(narrow), F.col("t").alias("ta")).join(large(sets.filter(narrow), F.col("t").alias("tb")), [*within, "term"]).filter(smaller)
    near = met.filter(F.get(F.array_intersect("ta", "tb"), F.lit(0)) == F.col("term"))
    far = small(sets).join(large(sets.filter(~narrow)), [*within, "term"]).filter(smaller).select(*within, "a", "b").distinct()
    far = far.join(sets.withColumnsRenamed({"k": "a", "t": "ta"}), [*within, "a"]).join(sets.withColumnsRenamed({"k": "b", "t": "tb"}), [*within, "b"])
    both = near.select(*within, "a", "b", (shared / base).alias("overlap")).unionByName(far.select(*within, "a", "b", (shared / base).alias("overlap")))
    return both.filter(F.col("overlap") > floor).select(*within, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("overlap", 6).alias("overlap"))


def degree(edges: DataFrame) -> DataFrame:
    """AG-22 part: links of each node, either side."""
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("links"))


def _turn_words(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3).alias("words"))


def _order_parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))


def _order_months(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.collect_set("month").alias("months"))


QUERIES = {
    "jn17_adjacent": lambda s, d: adjacent(table(s, d, "conversations"), ["conv_id"], "turn", "turn"),
    "jn14_shared_words": lambda s, d: shared_terms(_turn_words(s, d), ["conv_id"], "turn", "words", 0.05, "union"),
    "jn16_shared_entities": lambda s, d: shared_terms(_order_parts(s, d), [], "l_orderkey", "parts", 0.4),
    "jn15_shared_dates": lambda s, d: shared_terms(_order_months(s, d), ["o_custkey"], "o_orderkey", "months", 0.2),
    "ag22_degree": lambda s, d: degree(shared_terms(_order_parts(s, d), [], "l_orderkey", "parts", 0.4)),
}
_PAIR = """SELECT x.{g} AS {g}, x.k AS a, y.k AS b, round({c} / {den}, 6) AS overlap FROM t x JOIN t y ON x.{g} = y.{g} AND x.k < y.k WHERE {c} > 0 AND {c} / {den} > {f}"""
_C = "len(list_intersect(x.s, y.s))::DOUBLE"
_MIN = "least(len(x.s), len(y.s))"
_PARTS = """e AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), n AS (SELECT k, count(*) AS n FROM e GROUP BY 1),
 c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM e x JOIN e y ON x.p = y.p AND x.k < y.k GROUP BY 1, 2),
 o AS (SELECT a, b, round(c::DOUBLE / least(x.n, y.n), 6) AS overlap FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c::DOUBLE / least(x.n, y.n) > 0.4)"""
ORACLE_SQL = {
    "jn17_adjacent": "SELECT conv_id, turn AS source_id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target_id FROM conversations QUALIFY target_id IS NOT NULL",
    "jn14_shared_words": "WITH t AS (SELECT conv_id, turn AS k, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3)) AS s FROM conversations) "
    + _PAIR.format(g="conv_id", c=_C, den=f"(len(x.s) + len(y.s) - {_C})", f=0.05),
    "jn16_shared_entities": f"WITH {_PARTS} SELECT a, b, overlap FROM o",
    "jn15_shared_dates": "WITH t AS (SELECT o_custkey, o_orderkey AS k, list(DISTINCT strftime(l_shipdate, '%Y-%m')) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) "
    + _PAIR.format(g="o_custkey", c=_C, den=_MIN, f=0.2),
    "ag22_degree": f"WITH {_PARTS} SELECT node, count(*) AS links FROM (SELECT a AS node FROM o UNION ALL SELECT b FROM o) GROUP BY 1",
}
