"""Table analytics over cells in long form: numeric and chartable columns, samples, totals, summary rows, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import numeric_text, parse_number
from marlstone.session import table


def long_form(rows: DataFrame, sheet: str, key: str) -> DataFrame:
    """sheet, row, column name and cell text, one pass over the rows."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rows.columns if c not in (key, "sheet")]
    return rows.select(F.lit(sheet).alias("sheet"), F.col(key).alias("row_key"), F.explode(F.array(*cells)).alias("cell")).select("sheet", "row_key", "cell.*")


def numeric_columns(cells: DataFrame, share: float = 0.7) -> DataFrame:
    """AG-36: columns with a numeric share of ``share`` or more among cells that are not blank."""
    full = F.col("value").isNotNull() & (F.trim("value") != "")
    return cells.groupBy("sheet", "column").agg(
        F.count_if(full).alias("filled"),
        F.coalesce(F.count_if(full & numeric_text(F.col("value"))) / F.count_if(full) >= share, F.lit(False)).alias("numeric"),
    )


def chartable_columns(cells: DataFrame, numeric: DataFrame) -> DataFrame:
    """AG-37: numeric columns without balance or running total in their name whose largest magnitude is at least a twentieth of
    the sheet's."""
    names = numeric.filter(F.col("numeric") & ~F.lower("column").rlike("balance|running total")).select("sheet", "column")
    most = cells.join(F.broadcast(names), ["sheet", "column"]).groupBy("sheet", "column").agg(F.max(F.abs(parse_number(F.col("value")))).alias("largest"))
    overall = F.max("largest").over(Window.partitionBy("sheet"))
    return most.withColumn("overall", overall).filter(F.col("largest") >= F.col("overall") / 20).select("sheet", "column", F.round("largest", 4).alias("largest"))


def column_samples(cells: DataFrame, k: int = 5) -> DataFrame:
    """AG-30: distinct values of a column and its first ``k`` values; each task keeps ``k`` candidates only."""
    place = F.row_number().over(Window.partitionBy("sheet", "column").orderBy("row_key"))
    counts = cells.groupBy("sheet", "column").agg(F.count_distinct("value").alias("unique_values"))
    first = cells.withColumn("place", place).filter(F.col("place") <= k).groupBy("sheet", "column").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "value")))["value"], ";").alias("sample"))
    return counts.join(first, ["sheet", "column"])


def column_totals(cells: DataFrame, named: str) -> DataFrame:
    """AG-33: totals of columns whose name matches."""
    return cells.filter(F.lower("column").rlike(named)).groupBy("sheet", "column").agg(F.round(F.sum(parse_number(F.col("value"))), 2).alias("total"))


def summary_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """PF-19: whether a row's text holds a summary word."""
    return rows.withColumn("is_summary", F.lower(F.concat_ws(" ", *columns)).rlike("total|sum|subtotal|grand total|summary"))


def column_roles(names: DataFrame) -> DataFrame:
    """SC-96: role of a column by its name, the first that fits."""
    n = F.lower("column")
    role = (
        F.when(n.rlike("date|time"), "date")
        .when(n.rlike("price|cost|acctbal|total|amount|tax|discount"), "amount")
        .when(n.rlike("qty|quantity|size"), "quantity")
        .when(n.rlike("name|customer|supp"), "party")
        .when(n.rlike("status|flag|priority"), "status")
        .when(n.rlike("key|id"), "reference")
        .otherwise("text")
    )
    return names.withColumn("role", role)


def workbook(cells: DataFrame) -> DataFrame:
    """AG-29: cells and complexity of each sheet by its rows; AG-32: data density."""
    rows = F.count_distinct("row_key")
    return cells.groupBy("sheet").agg(
        F.count("*").alias("cells"),
        F.when(rows > 1000, "complex").when(rows > 100, "medium").otherwise("simple").alias("complexity"),
        F.round(F.count("value") / F.count("*"), 4).alias("density"),
    )


def _orders(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("o_totalprice"), "o_orderpriority")
    return long_form(o, "orders", "o_orderkey")


QUERIES = {
    "ag36_numeric_columns": lambda s, d: numeric_columns(_orders(s, d)),
    "ag37_chartable_columns": lambda s, d: chartable_columns(_orders(s, d), numeric_columns(_orders(s, d))),
    "ag30_column_samples": lambda s, d: column_samples(_orders(s, d)),
    "ag33_column_totals": lambda s, d: column_totals(_orders(s, d), "price"),
    "ag29_workbook": lambda s, d: workbook(_orders(s, d)),
    "pf19_summary_rows": lambda s, d: summary_rows(table(s, d, "part"), ["p_name", "p_type"]).select("p_partkey", "is_summary"),
    "sc96_column_roles": lambda s, d: column_roles(numeric_columns(_orders(s, d)).select("column")),
}
_CELLS = """cells AS (SELECT 'orders' AS sheet, o_orderkey AS row_key, unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS "column",
 unnest([CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR), o_orderpriority]) AS value FROM orders)"""
_NUM = """num AS (SELECT sheet, "column", count(*) FILTER (trim(value) <> '') AS filled, count(*) FILTER (regexp_matches(value, '^\\s*-?[0-9][0-9,]*(\\.[0-9]+)?\\s*$'))::DOUBLE / count(*) FILTER (trim(value) <> '') >= 0.7 AS "numeric" FROM cells GROUP BY 1, 2)"""
ORACLE_SQL = {
    "ag36_numeric_columns": f"WITH {_CELLS}, {_NUM} SELECT * FROM num",
    "ag37_chartable_columns": f"""WITH {_CELLS}, {_NUM}, m AS (SELECT sheet, "column", max(abs(CAST(value AS DOUBLE))) AS largest FROM cells JOIN (SELECT sheet, "column" FROM num WHERE "numeric" AND NOT regexp_matches(lower("column"), 'balance|running total')) USING (sheet, "column") GROUP BY 1, 2)
 SELECT sheet, "column", round(largest, 4) AS largest FROM m WHERE largest >= (SELECT max(largest) FROM m) / 20""",
    "ag30_column_samples": f"""WITH {_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_key) AS k FROM cells) SELECT sheet, "column", count(DISTINCT value) AS unique_values, string_agg(value, ';' ORDER BY k) FILTER (k <= 5) AS sample FROM r GROUP BY 1, 2""",
    "ag33_column_totals": f"""WITH {_CELLS} SELECT sheet, "column", round(sum(CAST(value AS DOUBLE)), 2) AS total FROM cells WHERE regexp_matches(lower("column"), 'price') GROUP BY 1, 2""",
    "ag29_workbook": f"WITH {_CELLS} SELECT sheet, count(*) AS cells, CASE WHEN count(DISTINCT row_key) > 1000 THEN 'complex' WHEN count(DISTINCT row_key) > 100 THEN 'medium' ELSE 'simple' END AS complexity, round(count(value)::DOUBLE / count(*), 4) AS density FROM cells GROUP BY 1",
    "pf19_summary_rows": "SELECT p_partkey, regexp_matches(lower(p_name || ' ' || p_type), 'total|sum|subtotal|grand total|summary') AS is_summary FROM part",
    "sc96_column_roles": f"""WITH {_CELLS}, n AS (SELECT DISTINCT "column" FROM cells) SELECT "column", CASE WHEN regexp_matches("column", 'date|time') THEN 'date' WHEN regexp_matches("column", 'price|cost|acctbal|total|amount|tax|discount') THEN 'amount' WHEN regexp_matches("column", 'qty|quantity|size') THEN 'quantity' WHEN regexp_matches("column", 'name|customer|supp') THEN 'party' WHEN regexp_matches("column", 'status|flag|priority') THEN 'status' WHEN regexp_matches("column", 'key|id') THEN 'reference' ELSE 'text' END AS role FROM n""",
}
