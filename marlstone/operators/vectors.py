"""Exact vector search: similarity expressions, single-probe top-k, and batches of probes in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """SC-03, SC-09: a zero norm product becomes 1e-12."""
    scale = norm(a) * norm(b)
    return dot(a, b) / F.when(scale == 0, F.lit(1e-12)).otherwise(scale)


def cosine_or_zero(a: Column, b: Column) -> Column:
    """SC-04: 0 where a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def probe_topk(vectors: DataFrame, probe: list[float], k: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """TK-01, TK-02: the ``max(1, k)`` nearest rows of one probe; the probe is a literal, the plan a bounded heap."""
    q = F.array(*[F.lit(float(x)) for x in probe])
    return vectors.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), key).limit(max(1, k))


def _pack(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of fixed-size blocks as arrays, so that blocks and not rows are paired."""
    rows = rows.select(key, vector).withColumn("part", F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.lit(size))))
    return rows.groupBy("part").agg(F.collect_list(F.struct(key, vector)).alias(name)).drop("part")


def batch_topk(spark: SparkSession, vectors: DataFrame, probes: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """JN-11: nearest rows of a stated set of probes, in blocks of probes against blocks of rows. Each pair of blocks gives its
    k best for each probe by one matrix product; a window keeps the best k of those. A probe never meets itself."""
    n, m = vectors.count(), probes.count()
    rows = _pack(vectors, key, vector, max(1, n // block), "r")
    asked = _pack(probes, key, vector, max(1, m // block), "q")

    def best(frames):
        for frame in frames:
            for q, r in zip(frame["q"], frame["r"]):
                a = np.array([list(x[vector]) for x in q], dtype=np.float64)
                b = np.array([list(x[vector]) for x in r], dtype=np.float64)
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
                qi, ri = np.array([x[key] for x in q]), np.array([x[key] for x in r])
                sims = a @ b.T
                sims[qi[:, None] == ri[None, :]] = -2
                t = min(k, len(ri))
                near = np.argpartition(-sims, t - 1, axis=1)[:, :t]
                score = np.take_along_axis(sims, near, 1).ravel()
                out = pd.DataFrame({"probe": np.repeat(qi, t), "vec_id": ri[near].ravel(), "score": score})
                yield out[out["score"] > -2]

    found = rows.crossJoin(asked).mapInPandas(best, "probe long, vec_id long, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")  # k rows from each block
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-4 of probe 0 with the confidence gate over them."""
    v = table(spark, sf_dir, "embeddings")
    first = v.filter("vec_id = 0").select("embedding").first()
    probe = list(first["embedding"]) if first else [0.0]
    top = probe_topk(v.filter("vec_id <> 0"), probe, 4)
    w = Window.partitionBy()
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"),  # four rows
        "vec_id",
        "label",
        F.round("score", 6).alias("score"),
        F.round(F.max("score").over(w), 6).alias("confidence"),
        F.bround(F.size(F.collect_set("label").over(w)) / F.count("*").over(w), 2).alias("diversity"),
        (F.max("score").over(w) < 0.5).alias("used_fallback"),
    )


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return batch_topk(spark, v, v.filter("vec_id % 100 = 0"), 5).select("probe", "vec_id", "rank", F.round("score", 6).alias("score"))


def _similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    first = v.filter("vec_id = 0").select("embedding").first()
    q = F.array(*[F.lit(float(x)) for x in (first["embedding"] if first else [0.0])])
    e = F.col("embedding")
    return v.select(
        "vec_id",
        F.round(cosine(e, q), 6).alias("cosine"),
        F.round(1 - cosine(e, q), 6).alias("distance"),
        F.round(dot(F.slice(e, 1, 16), F.slice(q, 1, 16)), 5).alias("head_dot"),
        (F.size(e) == 64).alias("dim_ok"),
    )


QUERIES = {"tk_cosine_topk": _entry, "jn11_batch_topk": _batch, "sc03_similarities": _similarities}
_P = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
ORACLE_SQL = {
    "tk_cosine_topk": f"""WITH t AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, {_P} WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 4)
 SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, label, round(score, 6) AS score, round(max(score) OVER (), 6) AS confidence, round_even((SELECT count(DISTINCT label) FROM t)::DOUBLE / count(*) OVER (), 2) AS diversity, max(score) OVER () < 0.5 AS used_fallback FROM t""",
    "jn11_batch_topk": """WITH p AS (SELECT a.vec_id AS probe, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id) AS rank FROM p) SELECT probe, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "sc03_similarities": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance, round(list_inner_product((embedding::DOUBLE[])[1:16], q[1:16]), 5) AS head_dot, len(embedding) = 64 AS dim_ok FROM embeddings, {_P}",
}
