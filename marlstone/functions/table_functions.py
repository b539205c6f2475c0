"""UDF surface: the table functions ``match_chunks`` and ``match_queries``, callable from SQL, and the same as DataFrames.

Both read the views ``fact_embedding``, ``fact_chunk``, ``dim_document``, ``fact_query`` and ``fact_query_embedding``. A probe is
a JSON array of numbers as text. Distance is one minus the cosine; it is NaN where a vector has no length, and such rows come
last, null vectors after them; a vector of another dimension than the probe's raises. Equal distances are ordered by id. A null
count gives all rows.

Rows are ranked within ``BUCKETS`` buckets of their ids first and only the best of each bucket are ranked against each other, so
no task sorts all scores; only ids and scores take part, texts are looked up for the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table

BUCKETS = 256
#: The least similarity of a question that counts as a similar one.
SIMILAR = 0.8

_DISTANCE = """CASE WHEN size({v}) <> size(from_json(query_embedding, 'array<double>')) THEN raise_error('different vector dimensions')
   WHEN aggregate({v}, 0D, (s, x) -> s + double(x) * double(x)) * aggregate(from_json(query_embedding, 'array<double>'), 0D, (s, x) -> s + x * x) = 0 THEN double('NaN')
   ELSE 1 - aggregate(zip_with({v}, from_json(query_embedding, 'array<double>'), (x, y) -> double(x) * y), 0D, (s, x) -> s + x)
    / (sqrt(aggregate({v}, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(from_json(query_embedding, 'array<double>'), 0D, (s, x) -> s + x * x))) END"""
_BEST = """SELECT id, distance FROM (
  SELECT id, distance, row_number() OVER (ORDER BY distance NULLS LAST, id) AS place FROM (
   SELECT id, distance, row_number() OVER (PARTITION BY pmod(xxhash64(id), {buckets}) ORDER BY distance NULLS LAST, id) AS place_in_bucket FROM ({rows}))
  WHERE match_count IS NULL OR place_in_bucket <= match_count)
 WHERE match_count IS NULL OR place <= match_count"""
_CHUNK_ROWS = """SELECT fe.chunk_id AS id, {distance} AS distance FROM fact_embedding fe JOIN fact_chunk fc ON fc.chunk_id = fe.chunk_id JOIN dim_document dd ON dd.document_id = fc.document_id WHERE dd.is_active"""
_QUERY_ROWS = """SELECT query_id AS id, {distance} AS distance FROM fact_query_embedding WHERE exclude_query_id IS NULL OR query_id <> exclude_query_id"""
MATCH_CHUNKS = f"""CREATE OR REPLACE TEMPORARY FUNCTION match_chunks(query_embedding STRING, match_count INT DEFAULT 4)
RETURNS TABLE (chunk_id STRING, document_id STRING, text STRING, metadata STRING, similarity DOUBLE, title STRING, department STRING, source_type STRING, source_path STRING)
RETURN SELECT fc.chunk_id, fc.document_id, fc.text, fc.metadata, 1 - b.distance, dd.title, dd.department, dd.source_type, dd.source_path
FROM ({_BEST.format(buckets=BUCKETS, rows=_CHUNK_ROWS.format(distance=_DISTANCE.format(v="fe.embedding")))}) b
JOIN fact_chunk fc ON fc.chunk_id = b.id JOIN dim_document dd ON dd.document_id = fc.document_id"""
MATCH_QUERIES = f"""CREATE OR REPLACE TEMPORARY FUNCTION match_queries(query_embedding STRING, match_count INT DEFAULT 5, exclude_query_id STRING DEFAULT NULL)
RETURNS TABLE (query_id STRING, query_text STRING, similarity DOUBLE, created_at TIMESTAMP)
RETURN SELECT fq.query_id, fq.query_text, 1 - b.distance, fq.created_at
FROM ({_BEST.format(buckets=BUCKETS, rows=_QUERY_ROWS.format(distance=_DISTANCE.format(v="embedding")))}) b JOIN fact_query fq ON fq.query_id = b.id"""


def register(spark: SparkSession) -> None:
    """Makes both functions known to the session, whose views must be there."""
    spark.sql(MATCH_CHUNKS)
    spark.sql(MATCH_QUERIES)


def distance(vector: Column, probe: Column) -> Column:
    """One minus the cosine, NaN where a vector has no length."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    product = F.aggregate(F.zip_with(vector, probe, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(square(vector)) * F.sqrt(square(probe))
    wrong = F.size(vector) != F.size(probe)
    return F.when(wrong, F.raise_error(F.lit("different vector dimensions")).cast("double")).when(scale == 0, F.lit(float("nan"))).otherwise(1 - product / scale)


def match_chunks(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame, probe: list[float], match_count: int = 4) -> DataFrame:
    """The table function as a DataFrame: the nearest chunks of active documents."""
    q = F.array(*[F.lit(float(x)) for x in probe])
    active = chunks.select("chunk_id", "document_id").join(documents.filter("is_active").select("document_id"), "document_id")
    scored = embeddings.join(active, "chunk_id").select("chunk_id", distance(F.col("embedding"), q).alias("distance"))
    best = scored.orderBy(F.asc_nulls_last("distance"), "chunk_id").limit(match_count)
    out = chunks.join(best, "chunk_id").join(documents, "document_id")
    return out.select("chunk_id", "document_id", "text", "metadata", (1 - F.col("distance")).alias("similarity"), "title", "department", "source_type", "source_path")


def match_queries(vectors: DataFrame, queries: DataFrame, probe: list[float], match_count: int = 5, exclude_query_id: str | None = None) -> DataFrame:
    """The table function as a DataFrame: the nearest earlier questions, but the excluded one."""
    q = F.array(*[F.lit(float(x)) for x in probe])
    rows = vectors if exclude_query_id is None else vectors.filter(F.col("query_id") != exclude_query_id)
    best = rows.select("query_id", distance(F.col("embedding"), q).alias("distance")).orderBy(F.asc_nulls_last("distance"), "query_id").limit(match_count)
    return queries.join(best, "query_id").select("query_id", "query_text", (1 - F.col("distance")).alias("similarity"), "created_at")


def similar_queries(spark: SparkSession, probe: str, match_count: int = 5, exclude_query_id: str | None = None, floor: float = SIMILAR, user_id: str | None = None) -> DataFrame:
    """PF-08, PF-14 by the SQL function: the nearest first, then the floor, so fewer than ``match_count`` may return; with a user,
    only questions that this user asked are left of them."""
    near = spark.sql("SELECT * FROM match_queries(:probe, :k, :not_this)", args={"probe": probe, "k": match_count, "not_this": exclude_query_id})
    near = near.filter((F.col("similarity") >= floor) & ~F.isnan("similarity"))
    if user_id is not None:
        near = near.join(spark.table("fact_query").filter(F.col("user_id") == user_id).select("query_id"), "query_id", "left_semi")
    return near


def star_views(spark: SparkSession, sf_dir: str) -> None:
    """The views on the given tables: each source is a document, active unless its number of characters divides by three; texts
    are its chunks, events the questions, and vectors go by id."""
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding").createOrReplaceTempView("fact_embedding")
    docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), "text", F.to_json(F.struct("lang", "n_chars")).alias("metadata")).createOrReplaceTempView("fact_chunk")
    sources = docs.groupBy("source").agg(F.sum("n_chars").alias("n"), F.min("lang").alias("lang"), F.max("lang").alias("last"))
    sources.select(
        F.col("source").alias("document_id"), F.concat(F.lit("Source "), "source").alias("title"), F.col("lang").alias("department"), F.col("last").alias("source_type"),
        F.concat(F.lit("/"), "source").alias("source_path"), (F.col("n") % 3 > 0).alias("is_active"),
    ).createOrReplaceTempView("dim_document")
    asked = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("query_id"), F.concat_ws(" ", "event_type", "props").alias("query_text"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").cast("string").alias("user_id"))
    asked.createOrReplaceTempView("fact_query")
    e.select(F.col("vec_id").cast("string").alias("query_id"), "embedding").createOrReplaceTempView("fact_query_embedding")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    star_views(s, d)
    register(s)
    found = s.sql("SELECT * FROM match_chunks((SELECT to_json(embedding) FROM fact_embedding WHERE chunk_id = '0'), 10)")
    return found.withColumn("similarity", F.round("similarity", 6))


def _queries(s: SparkSession, d: str) -> DataFrame:
    star_views(s, d)
    register(s)
    found = s.sql("SELECT * FROM match_queries((SELECT to_json(embedding) FROM fact_query_embedding WHERE query_id = '0'), 10, '0') WHERE similarity >= 0.3")
    return found.withColumn("similarity", F.round("similarity", 6))


QUERIES = {"tf_match_chunks": _chunks, "tf_match_queries": _queries}
_PROBE = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
ORACLE_SQL = {
    "tf_match_chunks": f"""WITH dd AS (SELECT source, 'Source ' || source AS title, min(lang) AS department, max(lang) AS source_type, '/' || source AS source_path, sum(n_chars) % 3 > 0 AS is_active FROM documents GROUP BY source)
 SELECT CAST(vec_id AS VARCHAR) AS chunk_id, dd.source AS document_id, text, '{{"lang":"' || lang || '","n_chars":' || n_chars || '}}' AS metadata, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity, title, department, source_type, source_path
 FROM embeddings JOIN documents ON doc_id = vec_id JOIN dd ON dd.source = documents.source, {_PROBE} WHERE is_active ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, CAST(vec_id AS VARCHAR) LIMIT 10""",
    "tf_match_queries": f"""WITH n AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {_PROBE} WHERE vec_id <> 0 ORDER BY s DESC, CAST(vec_id AS VARCHAR) LIMIT 10)
 SELECT CAST(id AS VARCHAR) AS query_id, event_type || ' ' || props AS query_text, round(s, 6) AS similarity, CAST(ts AS TIMESTAMP) AS created_at FROM n JOIN events ON event_id = id WHERE s >= 0.3""",
}
