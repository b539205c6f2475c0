"""Retrieval: result normalisation, filters, joins of the star schema, the confidence gate with its second path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.vectors import cosine
from marlstone.session import table


def first_text(*aliases: str) -> Column:
    """PF-01: the first alias that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(a), F.lit("")) for a in aliases], F.lit(""))


def first_score(*aliases: str) -> Column:
    """PF-01: the first score that is neither null nor 0, as truthiness has it."""
    return F.coalesce(*[F.nullif(F.col(a).cast("double"), F.lit(0.0)) for a in aliases], F.lit(0.0))


def natural_key(external_id: str, folder: str, name: str) -> Column:
    """PF-05: the external id, else ``folder/name``."""
    return F.coalesce(F.nullif(F.col(external_id), F.lit("")), F.concat_ws("/", folder, name))


def coerce_enum(value: Column, allowed: tuple[str, ...]) -> Column:
    """PF-06: values outside the list become its first."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(allowed[0]))


def filter_dsl(spec: dict) -> Column:
    """PF-12, PF-13: ``{column: value}``, ``{"$in": [...]}``, ``{"$overlap": [...]}``, ``{"min": a, "max": b}`` as one predicate."""
    out = F.lit(True)
    for name, want in spec.items():
        c = F.col(name)
        if not isinstance(want, dict):
            out = out & (c == want)
            continue
        if "$in" in want:
            out = out & c.isin(*want["$in"])
        if "$overlap" in want:
            out = out & F.arrays_overlap(c, F.array(*[F.lit(v) for v in want["$overlap"]]))
        if want.get("min") is not None:
            out = out & (c >= want["min"])
        if want.get("max") is not None:
            out = out & (c <= want["max"])
    return out


def filtered_or_all(rows: DataFrame, predicate: Column, by: str) -> DataFrame:
    """PF-16, WN-09: within each ``by``, the rows that pass, or all if none do. Hits are counted with partial sums, so a large
    ``by`` is not gathered in one task."""
    hits = rows.filter(predicate).groupBy(F.col(by).alias("_key")).agg(F.lit(True).alias("_hits"))
    return rows.join(hits, F.col(by).eqNullSafe(F.col("_key")), "left").filter(predicate | F.col("_hits").isNull()).drop("_key", "_hits")


def overfetch(rows: DataFrame, predicate: Column, by: str, order: list[Column], k: int) -> DataFrame:
    """PF-17: the best 2k of each ``by``, then the predicate, then the best k of what is left."""
    w = Window.partitionBy(by).orderBy(*order)
    first = rows.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= 2 * k).filter(predicate)
    return first.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= k).drop("_p")


def gate(primary: DataFrame, fallback: DataFrame, query: str = "query_id", threshold: float = 0.5) -> DataFrame:
    """SC-10: a query keeps its primary results if their best score reaches ``threshold``; otherwise its fallback results
    replace them where there are any, even if they score less. Both inputs: query, doc_id, score."""
    p = primary.groupBy(query).agg(F.max("score").alias("confidence"))
    f = fallback.select(query).distinct().withColumn("has_fallback", F.lit(True))
    queries = p.join(f, query, "full").select(
        query,
        (F.coalesce("confidence", F.lit(0.0)) < threshold).alias("attempted"),
        ((F.coalesce("confidence", F.lit(0.0)) < threshold) & F.col("has_fallback").isNotNull()).alias("used_fallback"),
    )
    rows = primary.withColumn("path", F.lit("primary")).unionByName(fallback.withColumn("path", F.lit("fallback")))
    return rows.join(queries, query).filter((F.col("path") == "fallback") == F.col("used_fallback"))


def similar_questions(vectors: DataFrame, probe: Column, k: int = 5, floor: float = 0.8, exclude: int | None = None) -> DataFrame:
    """PF-08, PF-14: the k nearest first, then the floor, so fewer than k may return; none if the probe is null."""
    rows = vectors if exclude is None else vectors.filter(F.col("vec_id") != exclude)
    near = rows.withColumn("_probe", probe).withColumn("score", cosine(F.col("embedding"), F.col("_probe"))).drop("_probe")
    return near.orderBy(F.desc_nulls_last("score"), "vec_id").limit(k).filter(F.col("score") >= floor)


def match_queries(vectors: DataFrame, vec_id: int, k: int, floor: float = 0.0) -> DataFrame:
    """The table function of the reference's SQL: the ``k`` nearest of the others to one stored vector."""
    return similar_questions(vectors, vectors.filter(F.col("vec_id") == vec_id).agg(F.first("embedding")).scalar(), k, floor, vec_id)


def _star(s: SparkSession, d: str) -> DataFrame:
    """JN-01, JN-02, PF-07: embedding, chunk and document joined, inactive documents left out."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    docs = table(s, d, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 10 != 3).alias("is_active"))
    return e.join(docs.filter("is_active"), e["vec_id"] == docs["doc_id"]).select("vec_id", "label", "source", "lang")


def _with_labels(s: SparkSession, d: str) -> DataFrame:
    """JN-03: left join with defaults."""
    labels = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(s, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"))


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "events")
    base = e.select(F.col("event_id").alias("query_id"), "event_type", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    primary = base.select("query_id", (F.col("query_id") * 3 + F.col("k")).alias("doc_id"), F.round((F.col("query_id") * 31 % 97) / 100 / F.col("k"), 4).alias("score"))
    fallback = base.filter("event_type <> 'purchase'").select("query_id", (F.col("query_id") * 5 + F.col("k")).alias("doc_id"), F.round((F.col("query_id") * 17 % 89) / 100 / F.col("k"), 4).alias("score"))
    return primary, fallback


QUERIES = {
    "jn01_star_join": _star,
    "jn03_left_defaults": _with_labels,
    "jn10_either_side": lambda s, d: (lambda o: o.filter("o_custkey % 50 = 1").select("o_orderkey").union(o.filter("o_orderkey % 50 = 1").select("o_orderkey")).distinct())(table(s, d, "orders")),
    "sc10_confidence_gate": lambda s, d: gate(*_candidates(s, d)).select("query_id", "doc_id", "score", "path", "attempted", "used_fallback"),
    "pf01_normalise": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.substring(first_text("text", "role"), 1, 40).alias("snippet"), first_score("turn", "conv_id").alias("score")),
    "pf05_natural_key": lambda s, d: table(s, d, "documents").withColumn("external", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.lit(""))).select("doc_id", natural_key("external", "source", "lang").alias("key")),
    "pf06_enum_coercion": lambda s, d: table(s, d, "events").select("event_id", coerce_enum(F.col("event_type"), ("view", "click", "purchase")).alias("kind")),
    "pf12_filter_dsl": lambda s, d: table(s, d, "orders").filter(filter_dsl({"o_orderstatus": {"$in": ["F", "O"]}, "o_totalprice": {"min": 1000, "max": 200000}})).select("o_orderkey", "o_orderstatus"),
    "pf16_filtered_or_all": lambda s, d: filtered_or_all(table(s, d, "documents").select("doc_id", "source", "n_chars"), F.col("n_chars") > 15000, "source"),
    "pf17_overfetch": lambda s, d: overfetch(table(s, d, "documents").select("doc_id", "source", "n_chars", "lang"), F.col("lang") == "en", "source", [F.desc("n_chars"), F.col("doc_id")], 5).select("doc_id", "source"),
    "pf14_similar_questions": lambda s, d: match_queries(table(s, d, "embeddings"), 3, 5, 0.3).select("vec_id", F.round("score", 6).alias("score")),
}
_B = "(SELECT event_id AS query_id, event_type, unnest([1, 2, 3]) AS k FROM events)"
ORACLE_SQL = {
    "jn01_star_join": "SELECT vec_id, label, source, lang FROM embeddings JOIN documents ON vec_id = doc_id WHERE doc_id % 10 <> 3",
    "jn03_left_defaults": "SELECT doc_id, source, coalesce(quality, -1) AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)",
    "jn10_either_side": "SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 1 OR o_orderkey % 50 = 1",
    "sc10_confidence_gate": f"""WITH p AS (SELECT query_id, query_id * 3 + k AS doc_id, round((query_id * 31 % 97) / 100::DOUBLE / k, 4) AS score FROM {_B}), f AS (SELECT query_id, query_id * 5 + k AS doc_id, round((query_id * 17 % 89) / 100::DOUBLE / k, 4) AS score FROM {_B} WHERE event_type <> 'purchase'),
 q AS (SELECT query_id, max(score) < 0.5 AS attempted, max(score) < 0.5 AND query_id IN (SELECT query_id FROM f) AS used_fallback FROM p GROUP BY 1)
 SELECT query_id, doc_id, score, path, attempted, used_fallback FROM (SELECT *, 'primary' AS path FROM p UNION ALL SELECT *, 'fallback' AS path FROM f) JOIN q USING (query_id) WHERE (path = 'fallback') = used_fallback""",
    "pf01_normalise": "SELECT conv_id, turn, substring(coalesce(nullif(text, ''), nullif(role, ''), ''), 1, 40) AS snippet, coalesce(nullif(turn::DOUBLE, 0), nullif(conv_id::DOUBLE, 0), 0.0::DOUBLE) AS score FROM conversations",
    "pf05_natural_key": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE source || '/' || lang END AS key FROM documents",
    "pf06_enum_coercion": "SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'view' END AS kind FROM events",
    "pf12_filter_dsl": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000",
    "pf16_filtered_or_all": "WITH t AS (SELECT doc_id, source, n_chars, count(*) FILTER (n_chars > 15000) OVER (PARTITION BY source) AS h FROM documents) SELECT doc_id, source, n_chars FROM t WHERE n_chars > 15000 OR h = 0",
    "pf17_overfetch": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents), u AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM t WHERE p <= 10 AND lang = 'en') SELECT doc_id, source FROM u WHERE r <= 5",
    "pf14_similar_questions": "SELECT vec_id, round(score, 6) AS score FROM (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 3 AND a.vec_id <> 3 ORDER BY score DESC, a.vec_id LIMIT 5) WHERE score >= 0.3",
}
