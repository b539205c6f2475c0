"""Corpus tables: chunk and sheet documents, citation logging, hydration, ages, facets, orderings, hash vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import table
from marlstone.sources.tables import CITATION_SQL, citations

HASH_DIMS = 384
#: Upper ages in days, their names and their relevance.
AGES = ((7, "week", 0.9), (30, "month", 0.9), (90, "quarter", 0.7), (365, "year", 0.5))


def chunk_documents(rows: DataFrame, prefix: str, ordinal: str, title: str, text: str) -> DataFrame:
    """SRC-38, WN-02: id ``prefix_ordinal``, text with its title above it."""
    return rows.select(F.concat_ws("_", prefix, F.col(ordinal).cast("string")).alias("id"), F.concat(title, F.lit("\n\n"), text).alias("text"))


def row_documents(rows: DataFrame, number: str, text: str, size: int = 10) -> DataFrame:
    """SRC-27: a document for each ``size`` rows of a sheet (``number`` counts from 1), and one about the sheet at -1."""
    chunk = F.floor((F.col(number) - 1) / size).cast("long").alias("chunk_index")
    parts = rows.groupBy(chunk).agg(F.array_join(F.sort_array(F.collect_list(F.struct(number, text)))[text], "\n").alias("text"))  # ``size`` rows each
    about = rows.agg(F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("text")).select(F.lit(-1).cast("long").alias("chunk_index"), "text")
    return parts.unionByName(about)


def log_citations(cited: DataFrame, documents: DataFrame) -> DataFrame:
    """SRC-20, JN-08, WN-01: citations that resolve to a document, ranked anew from 1 within their query."""
    found = cited.join(documents, cited["document_id"] == documents["doc_id"])
    w = Window.partitionBy("query_id").orderBy("citation_rank", "document_id")
    return found.withColumn("rank", F.row_number().over(w))


def hydrate(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """SRC-23, JN-09: chunks with their vector; those without are left out."""
    return chunks.join(vectors.filter("embedding is not null"), chunks["doc_id"] == vectors["vec_id"]).withColumn("dim", F.size("embedding"))


def neighbour_context(rows: DataFrame, within: str, order: str, value: str, reach: int = 3) -> DataFrame:
    """WN-04: what stands up to ``reach`` rows before and after."""
    w = Window.partitionBy(within).orderBy(order)
    around = lambda a, b: F.array_join(F.collect_list(value).over(w.rowsBetween(a, b)), "|")
    return rows.select(within, order, around(-reach, -1).alias("before"), around(1, reach).alias("after"))


def age_days(at: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), at)


def age_bucket(days: Column) -> Column:
    """JN-22: the first bucket that holds the age."""
    out = None
    for most, name, _ in AGES:
        out = F.when(days <= most, name) if out is None else out.when(days <= most, name)
    return out.otherwise("older")


def temporal_relevance(days: Column) -> Column:
    """SC-42: 0.5 where there is no date, else less with age."""
    out = F.when(days.isNull(), 0.5)
    for most, _, relevance in AGES:
        out = out.when(days <= most, relevance)
    return out.otherwise(0.3)


def context_score(score: Column, impact: Column, alignment: Column, temporal: Column, rank: Column) -> Column:
    """SC-59: weighted sum with the class of relevance (critical, high, medium, low)."""
    of_class = F.when(rank == "critical", 1.0).when(rank == "high", 0.7).when(rank == "medium", 0.5).otherwise(0.3)
    return 0.3 * score + 0.25 * impact + 0.2 * alignment + 0.15 * temporal + 0.1 * of_class


def most_common(values: DataFrame, column: str, k: int = 10) -> DataFrame:
    """AG-25: the ``k`` most frequent values, the smaller first on ties."""
    return values.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def facet_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """AG-26: counts and shares of each value of each facet, in one pass over the rows."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])).alias("f"))
    counts = each.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("facet")), 4))


def badges(rows: DataFrame, column: str) -> DataFrame:
    """AG-38, AG-39: counts with null as General, and their share of the largest."""
    counts = rows.groupBy(F.coalesce(column, F.lit("General")).alias("department")).agg(F.count("*").alias("n"))
    return counts.withColumn("bar", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6))  # a row for each department


def hash_vector(text: Column, dims: int = HASH_DIMS) -> Column:
    """SC-06: digits of a digest of text and place as numbers from -1 to 1, scaled to unit length."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(F.md5(F.concat_ws("_", text, i.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295 * 2 - 1)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return once(raw, lambda v: once(norm(v), lambda length: F.transform(v, lambda x: x / length)))  # the norm once, not for each number


def _ages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", age_days(F.col("o_orderdate").cast("date"), "1998-12-31").alias("days"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    rank = F.when(F.col("l_returnflag") == "A", "critical").when(F.col("l_returnflag") == "N", "high").otherwise("low")
    score = context_score(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(0.5), rank)
    return li.select("l_orderkey", "l_linenumber", F.round(score, 5).alias("final_score"))


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    """SO-03 to SO-05: words of a part's type and name."""
    a, b = F.split(F.lower("p_type"), " "), F.split(F.lower("p_name"), " ")
    return table(s, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("either"), F.array_join(F.array_sort(F.array_distinct(b)), " ").alias("words"))


QUERIES = {
    "src38_chunk_documents": lambda s, d: chunk_documents(table(s, d, "conversations").withColumn("c", F.col("conv_id").cast("string")), "c", "turn", "role", "text"),
    "src27_row_documents": lambda s, d: row_documents(table(s, d, "part").withColumn("number", F.col("p_partkey") + 1), "number", "p_name"),
    "src20_log_citations": lambda s, d: log_citations(citations(s, d), table(s, d, "documents").filter("lang <> 'de'").select("doc_id", "source")).select("query_id", "document_id", "rank", "relevance_score", "source"),
    "src23_hydrate": lambda s, d: hydrate(table(s, d, "documents").select("doc_id", "source"), table(s, d, "embeddings")).select("doc_id", "source", "label", "dim"),
    "wn04_neighbour_context": lambda s, d: neighbour_context(table(s, d, "conversations"), "conv_id", "turn", "role"),
    "jn22_age_buckets": lambda s, d: _ages(s, d).groupBy(age_bucket(F.col("days")).alias("age")).agg(F.count("*").alias("n")),
    "sc42_temporal_relevance": lambda s, d: _ages(s, d).select("o_orderkey", temporal_relevance(F.col("days")).alias("relevance")),
    "sc59_context_score": _scored,
    "ag25_most_common": lambda s, d: most_common(table(s, d, "lineitem").select(F.col("l_quantity").cast("int").alias("quantity")), "quantity"),
    "ag26_facet_rates": lambda s, d: facet_rates(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    "ag32_date_span": lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last")).withColumn("span", F.datediff("last", "first")),
    "ag38_badges": lambda s, d: badges(table(s, d, "documents"), "source"),
    "tk09_overflow_order": lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(20),
    "sc06_hash_vectors": lambda s, d: table(s, d, "nation").select("n_nationkey", hash_vector(F.col("n_name")).alias("v")).select("n_nationkey", F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(383)), 6).alias("last")),
    "so04_set_overlap": _overlaps,
}
_AGE = "date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31')"
_RAW = f"list_transform(range({HASH_DIMS}), lambda i: CAST('0x' || substr(md5(n_name || '_' || i), 1, 8) AS BIGINT)::DOUBLE / 4294967295 * 2 - 1)"
_FACET = "SELECT '{c}' AS facet, {c} AS value, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS rate FROM orders GROUP BY {c}"
ORACLE_SQL = {
    "src38_chunk_documents": "SELECT conv_id || '_' || turn AS id, role || chr(10) || chr(10) || text AS text FROM conversations",
    "src27_row_documents": "SELECT p_partkey // 10 AS chunk_index, string_agg(p_name, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1 UNION ALL SELECT -1, count(*) || ' rows' FROM part",
    "src20_log_citations": f"SELECT query_id, document_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY citation_rank, document_id) AS INT) AS rank, relevance_score, source FROM ({CITATION_SQL}) JOIN documents ON doc_id = document_id WHERE lang <> 'de'",
    "src23_hydrate": "SELECT doc_id, source, label, CAST(len(embedding) AS INT) AS dim FROM documents JOIN embeddings ON doc_id = vec_id WHERE embedding IS NOT NULL",
    "wn04_neighbour_context": """SELECT conv_id, turn, coalesce(string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS "before",
 coalesce(string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS "after" FROM conversations""",
    "jn22_age_buckets": f"SELECT CASE WHEN {_AGE} <= 7 THEN 'week' WHEN {_AGE} <= 30 THEN 'month' WHEN {_AGE} <= 90 THEN 'quarter' WHEN {_AGE} <= 365 THEN 'year' ELSE 'older' END AS age, count(*) AS n FROM orders GROUP BY 1",
    "sc42_temporal_relevance": f"SELECT o_orderkey, CAST(CASE WHEN o_orderdate IS NULL THEN 0.5 WHEN {_AGE} <= 30 THEN 0.9 WHEN {_AGE} <= 90 THEN 0.7 WHEN {_AGE} <= 365 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS relevance FROM orders",
    "sc59_context_score": "SELECT l_orderkey, l_linenumber, round(0.3::DOUBLE * l_discount + 0.25::DOUBLE * l_tax + 0.2::DOUBLE * (l_quantity / 50) + 0.075::DOUBLE + 0.1::DOUBLE * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.7 ELSE 0.3 END, 5) AS final_score FROM lineitem",
    "ag25_most_common": "SELECT CAST(l_quantity AS INT) AS quantity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, quantity LIMIT 10",
    "ag26_facet_rates": _FACET.format(c="o_orderstatus") + " UNION ALL " + _FACET.format(c="o_orderpriority"),
    "ag32_date_span": "SELECT o_orderstatus, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS INT) AS span FROM orders GROUP BY 1",
    "ag38_badges": "SELECT coalesce(source, 'General') AS department, count(*) AS n, round(count(*)::DOUBLE / max(count(*)) OVER (), 6) AS bar FROM documents GROUP BY 1",
    "tk09_overflow_order": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20",
    "sc06_hash_vectors": f"WITH t AS (SELECT n_nationkey, {_RAW} AS v FROM nation), u AS (SELECT n_nationkey, v, sqrt(list_inner_product(v, v)) AS s FROM t) SELECT n_nationkey, CAST(len(v) AS INT) AS dim, round(v[1] / s, 6) AS first, round(v[384] / s, 6) AS last FROM u",
    "so04_set_overlap": "WITH t AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS a, string_split(lower(p_name), ' ') AS b FROM part) SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INT) AS common, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS either, array_to_string(list_sort(list_distinct(b)), ' ') AS words FROM t",
}
