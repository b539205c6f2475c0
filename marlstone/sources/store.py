"""The write side: saved indexes, appended texts, keyed upserts of documents, chunks and vectors, query vectors, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.traversal import reachable
from marlstone.plans.samples import ASKED_SQL, asked, text_sql
from marlstone.session import table


def save_index(items: DataFrame, path: str) -> None:
    """SRC-17, SRC-29: id, text, metadata, vector as a table with the vectors' dimension; a vector that failed (null) is saved
    as zeros."""
    dim = items.agg(F.max(F.size("vector")).alias("d")).first()["d"] or 0
    zeros = F.array_repeat(F.lit(0.0), dim)
    items.select("id", "text", "metadata", F.coalesce("vector", zeros).alias("vector"), F.lit(dim).alias("dim")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_index`` wrote."""
    return spark.read.parquet(path).select("id", "text", "metadata", "vector")


def append_texts(index_path: str, texts: DataFrame, embed) -> None:
    """SRC-18: id, text, metadata get vectors from ``embed`` (column to column) and are appended; what is there stays, twice if
    it comes twice. A rebuild is ``save_index``."""
    vector = embed(F.col("text"))
    texts.select("id", "text", "metadata", vector.alias("vector"), F.size(vector).alias("dim")).write.mode("append").parquet(index_path)


def latest(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both; of each key that of the greatest version, of equal versions the new one, of equal new ones the greatest
    row."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, version, "is_new")]
    best = both.groupBy(*key).agg(F.max(F.struct(version, "is_new", *rest)).alias("best"))
    return best.select(*key, *[F.col(f"best.{c}").alias(c) for c in (version, *rest)])


def with_vectors(chunks: DataFrame, stored: DataFrame, embed) -> DataFrame:
    """SRC-19: chunks (document, ordinal, text, vector or null) with vectors. Those a document brings are used only if all its
    chunks have one, else all are made anew; a chunk whose text is stored with the same ordinal keeps the stored one then.
    ``reused`` tells which."""
    complete = chunks.groupBy("document").agg(F.bool_and(F.col("vector").isNotNull()).alias("complete"))
    known = stored.select("document", "ordinal", F.col("text").alias("old_text"), F.col("vector").alias("old_vector"))
    rows = chunks.join(complete, "document").join(known, ["document", "ordinal"], "left")
    same = F.col("old_text").eqNullSafe(F.col("text")) & F.col("old_vector").isNotNull()
    vector = F.when(F.col("complete"), F.col("vector")).when(same, F.col("old_vector")).otherwise(embed(F.col("text")))
    return rows.select("document", "ordinal", "text", vector.alias("vector"), (F.col("complete") | same).alias("reused"))


def upsert_counts(chunks: DataFrame) -> DataFrame:
    """SRC-19: one row of documents, chunks, embeddings, errors (chunks without a vector)."""
    return chunks.agg(F.count_distinct("document").alias("documents"), F.count("*").alias("chunks"), F.count("vector").alias("embeddings"), F.count_if(F.col("vector").isNull()).alias("errors"))


def earlier_queries(vectors: DataFrame, batch: str = "batch") -> DataFrame:
    """SRC-21, JN-02: pairs of a query and those logged in earlier batches; a query's vector is written after its log row, so
    it never meets itself."""
    other = vectors.select(F.col("query_id").alias("other_id"), F.col("user_id"), F.col(batch).alias("other_batch"))
    return vectors.join(other, "user_id").filter(F.col("other_batch") < F.col(batch)).select("query_id", "other_id")


def modified_after(manifest: DataFrame, since: str, column: str = "modified") -> DataFrame:
    """SRC-06."""
    return manifest.filter(F.col(column) > F.lit(since).cast("timestamp"))


def allowed(name: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """SRC-07: the first file of the list all of whose words a name holds, blanks, dashes and underscores apart; else null."""
    flat = F.regexp_replace(F.lower(name), "[ _-]+", "")
    out = F.lit(None).cast("string")
    for target in reversed(rules):
        hit = F.lit(True)
        for w in rules[target]:
            hit = hit & F.contains(flat, F.lit(w))
        out = F.when(hit, target).otherwise(out)
    return out


def below(folders: DataFrame, root: str) -> DataFrame:
    """SRC-08: all folders below ``root`` (columns id, parent), without itself. A folder that was seen is not looked into again,
    so a cycle ends."""
    edges = folders.select(F.col("parent").alias("source"), F.col("id").alias("target"))
    top = folders.sparkSession.range(1).select(F.lit(root).alias("root"))
    return reachable(edges, top).filter("hops > 0").select(F.col("node").alias("id"))


def file_documents(files: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-28: overview, entities and details document of each file."""
    text = {
        "overview": F.concat(F.lit("File "), F.col("name"), F.lit(" of "), F.col("department")),
        "entities": F.concat(F.lit("Entities: "), F.array_join("entities", ", ")),
        "details": F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns]),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in text.items()]))
    return files.select("id", each.alias("d")).select(F.concat_ws("_", "id", "d.kind").alias("id"), "d.kind", "d.text")


def _chunks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as chunks of customers: those of customers 0 to 6 of ten bring all vectors, others some; every third
    chunk is stored with the same text, every third with another one."""
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("document"), k.alias("ordinal"), F.concat(F.lit("c"), k).alias("text"), F.when((F.col("o_custkey") % 10 < 7) | (k % 4 > 0), F.array(k.cast("double"))).alias("vector"))
    stored = rows.filter("ordinal % 3 < 2").select("document", "ordinal", F.when(F.col("ordinal") % 3 == 0, F.col("text")).otherwise("other").alias("text"), F.array(F.lit(-1.0)).alias("vector"))
    return rows, stored


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return with_vectors(*_chunks(s, d), embed=lambda t: F.array(F.length(t).cast("double")))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).select("event_id", F.substring_index("file", "/", -1).alias("name"), F.col("ts").alias("modified"))


def _cyclic(s: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts of large order lines, each in the other's folder."""
    li = table(s, d, "lineitem").filter("l_quantity >= 49").select(F.concat(F.lit("s"), "l_suppkey").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("parent"))
    return li.unionByName(li.select(F.col("parent").alias("id"), F.col("id").alias("parent")))


RULES = {"cash": ("cash", "book"), "salary": ("salarysheet",), "any sheet": ("xlsx",)}
QUERIES = {
    "src19_reuse": lambda s, d: _vectors(s, d).select("document", "ordinal", F.element_at("vector", 1).alias("v"), "reused"),
    "src19_counts": lambda s, d: upsert_counts(_chunks(s, d)[0]),
    "src19_latest": lambda s, d: latest(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(s, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("l_linenumber"), (-F.col("l_partkey")).alias("l_partkey")), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey"),
    "src21_earlier_queries": lambda s, d: earlier_queries(table(s, d, "events").select(F.col("event_id").alias("query_id"), "user_id", F.floor(F.col("event_id") / 100).alias("batch"))).groupBy("query_id").agg(F.count("*").alias("n"), F.max("other_id").alias("last")),
    "src06_modified_after": lambda s, d: modified_after(_manifest(s, d), "1996-01-15 12:00:00").select("event_id"),
    "src07_allow_list": lambda s, d: _manifest(s, d).select("event_id", allowed(F.col("name"), RULES).alias("file")),
    "src08_subfolders": lambda s, d: below(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.floor(F.col("c_custkey") / 3).cast("string").alias("parent")).filter("id <> parent"), "5"),
    "src08_cyclic_folders": lambda s, d: below(_cyclic(s, d), "s1"),
    "src28_file_documents": lambda s, d: file_documents(table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("commercial").alias("department"), F.array("s_name", F.col("s_nationkey").cast("string")).alias("entities"), "s_nationkey"), ["s_nationkey"]),
}
_C = "(SELECT o_custkey AS document, o_orderkey AS ordinal, 'c' || o_orderkey AS text, CASE WHEN o_custkey % 10 < 7 OR o_orderkey % 4 > 0 THEN o_orderkey::DOUBLE END AS vector FROM orders)"
ORACLE_SQL = {
    "src19_reuse": f"SELECT document, ordinal, CASE WHEN complete THEN vector WHEN ordinal % 3 = 0 THEN -1::DOUBLE ELSE length(text)::DOUBLE END AS v, complete OR ordinal % 3 = 0 AS reused FROM (SELECT *, bool_and(vector IS NOT NULL) OVER (PARTITION BY document) AS complete FROM {_C})",
    "src19_counts": f"SELECT count(DISTINCT document) AS documents, count(*) AS chunks, count(vector) AS embeddings, count(*) FILTER (vector IS NULL) AS errors FROM {_C}",
    "src19_latest": "WITH b AS (SELECT l_orderkey, l_linenumber, 0 AS is_new, l_partkey FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber % 3, 1, -l_partkey FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, is_new DESC, l_partkey DESC) AS n FROM b) WHERE n = 1",
    "src21_earlier_queries": "SELECT a.event_id AS query_id, count(*) AS n, max(b.event_id) AS last FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id // 100 < a.event_id // 100 GROUP BY 1",
    "src06_modified_after": f"SELECT event_id FROM ({ASKED_SQL}) WHERE ts > TIMESTAMP '1996-01-15 12:00:00'",
    "src07_allow_list": f"SELECT event_id, CASE {' '.join('WHEN ' + ' AND '.join(f'contains(name, {text_sql(w)})' for w in words) + f' THEN {text_sql(k)}' for k, words in RULES.items())} END AS file FROM (SELECT event_id, regexp_replace(lower(string_split(file, '/')[-1]), '[ _-]+', '', 'g') AS name FROM ({ASKED_SQL}))",
    "src08_subfolders": "WITH RECURSIVE f AS (SELECT c_custkey AS id, c_custkey // 3 AS parent FROM customer WHERE c_custkey <> c_custkey // 3), t AS (SELECT id FROM f WHERE parent = 5 UNION SELECT f.id FROM f JOIN t ON f.parent = t.id) SELECT CAST(id AS VARCHAR) AS id FROM t",
    "src08_cyclic_folders": "WITH RECURSIVE f AS (SELECT 's' || l_suppkey AS id, 'p' || l_partkey AS parent FROM lineitem WHERE l_quantity >= 49 UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_quantity >= 49), t AS (SELECT id FROM f WHERE parent = 's1' UNION SELECT f.id FROM f JOIN t ON f.parent = t.id) SELECT id FROM t WHERE id <> 's1'",
    "src28_file_documents": "SELECT s_suppkey || '_' || kind AS id, kind, CASE kind WHEN 'overview' THEN 'File ' || s_name || ' of commercial' WHEN 'entities' THEN 'Entities: ' || s_name || ', ' || s_nationkey ELSE 's_nationkey: ' || s_nationkey END AS text FROM supplier, (SELECT unnest(['overview', 'entities', 'details']) AS kind)",
}
