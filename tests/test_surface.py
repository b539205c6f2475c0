"""Table functions, embedding providers and strategy registries."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import providers as P
from marlstone.functions import table_functions as T

VECTORS = {"a": [1.0, 0.0], "b": [0.6, 0.8], "c": [0.0, 1.0], "d": [0.0, 0.0], "e": [-1.0, 0.0], "f": None, "g": [2.0, 0.0]}


@pytest.fixture()
def facts(spark):
    e = spark.createDataFrame(list(VECTORS.items()), "chunk_id string, embedding array<float>")
    c = spark.createDataFrame([(k, "off" if k == "b" else "on", f"text {k}", "{}") for k in VECTORS], "chunk_id string, document_id string, text string, metadata string")
    d = spark.createDataFrame([("on", "On", "hr", "t", "/on", True), ("off", "Off", "hr", "t", "/off", False)], "document_id string, title string, department string, source_type string, source_path string, is_active boolean")
    q = spark.createDataFrame([(k, f"asked {k}", "u1" if k in "ab" else "u2") for k in VECTORS], "query_id string, query_text string, user_id string").withColumn("created_at", F.timestamp_seconds(F.lit(5)))
    for name, df in (("fact_embedding", e), ("fact_chunk", c), ("dim_document", d), ("fact_query", q), ("fact_query_embedding", e.withColumnRenamed("chunk_id", "query_id"))):
        df.createOrReplaceTempView(name)
    T.register(spark)
    return e, c, d, q


def flat(df):
    return [tuple(None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()]


@pytest.mark.parametrize("k", [1, 2, 4, 6, 100])
def test_match_chunks_from_sql(spark, facts, k):
    e, c, d, _ = facts
    got = sorted(flat(spark.sql(f"SELECT chunk_id, similarity, title FROM match_chunks('[1, 0]', {k})")), key=str)
    order = [("a", 1.0, "On"), ("g", 1.0, "On"), ("c", 0.0, "On"), ("e", -1.0, "On"), ("d", None, "On"), ("f", None, "On")]  # b is inactive
    assert got == sorted(order[:k], key=str)
    assert sorted(flat(T.match_chunks(e, c, d, [1.0, 0.0], k)), key=str) == sorted(flat(spark.sql(f"SELECT * FROM match_chunks('[1, 0]', {k})")), key=str)


def test_match_chunks_defaults_and_errors(spark, facts):
    assert spark.sql("SELECT * FROM match_chunks('[1, 0]')").count() == 4
    assert spark.sql("SELECT * FROM match_chunks('[1, 0]', 0)").count() == 0
    assert spark.sql("SELECT * FROM match_chunks('[1, 0]', NULL)").count() == 6
    with pytest.raises(Exception, match="different vector dimensions"):
        spark.sql("SELECT * FROM match_chunks('[1, 0, 0]', 2)").collect()
    by_row = spark.sql("SELECT p.k, m.chunk_id FROM VALUES ('x', '[1, 0]'), ('y', '[0, 1]') AS p(k, v), LATERAL match_chunks(p.v, 1) m").collect()
    assert sorted(map(tuple, by_row)) == [("x", "a"), ("y", "c")]


def test_match_chunks_keeps_the_best_of_each_bucket_only(spark, facts):
    plan = spark.sql("EXPLAIN SELECT * FROM match_chunks('[1, 0]', 3)").first()[0]
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


def test_match_queries_excludes_filters_and_cuts(spark, facts):
    e, _, _, q = facts
    got = flat(spark.sql("SELECT query_id, similarity FROM match_queries('[1, 0]', 3, 'a')"))
    assert sorted(got) == [("b", 0.6), ("c", 0.0), ("g", 1.0)]
    for skip in (None, "a", "zz"):
        want = T.match_queries(e.withColumnRenamed("chunk_id", "query_id"), q, [1.0, 0.0], 4, skip)
        args = "'[1, 0]', 4" + (f", '{skip}'" if skip else "")
        assert sorted(flat(want), key=str) == sorted(flat(spark.sql(f"SELECT * FROM match_queries({args})")), key=str)
    near = lambda **a: {r["query_id"] for r in T.similar_queries(spark, json.dumps([1, 0]), **a).collect()}
    assert near() == {"a", "g"} and near(exclude_query_id="a") == {"g"} and near(floor=0.5) == {"a", "b", "g"}
    assert near(user_id="u1") == {"a"} and near(match_count=1) == {"a"} and near(match_count=1, user_id="u2") == set()


def odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(["", None, "abc", "A é z", "fail here", "x" * 5000, "abc"])]
    return spark.createDataFrame(rows, "id long, text string").coalesce(1)


def test_registry_order():
    found = P.default_providers()
    assert found.choose().name == "hash" and found.choose("linear").dims == 1536
    found.register(P.Provider("remote", 3, function=lambda texts: [[0, 0, 0]] * len(texts)))
    assert found.choose().name == "remote"
    with pytest.raises(KeyError):
        found.choose("absent")
    with pytest.raises(LookupError):
        P.Providers(("remote",)).choose()
    with pytest.raises(ValueError):
        P.Providers().register(P.Provider("both", 3, function=len, expression=len))


def test_failed_batches_have_zero_vectors(spark):
    def sizes(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("the provider is down")
        return [[len(t), 1.0] for t in texts]

    p = P.Provider("sizes", 2, function=sizes, batch=2)
    got = P.embed(odd_texts(spark), p).orderBy("id").collect()
    assert [r["vector"] for r in got] == [[0, 1], [0, 1], [3, 1], [5, 1], [0, 0], [0, 0], [3, 1]]
    assert [r["embedded"] for r in got] == [True] * 4 + [False] * 2 + [True]
    other = P.Provider("spare", 2, expression=lambda t: F.array(F.lit(9.0), F.length(t).cast("double")))
    got = P.embed(odd_texts(spark), p, instead=other).orderBy("id").collect()
    assert [r["vector"] for r in got][4:6] == [[9, 9], [9, 5000]] and [r["provider"] for r in got][3:6] == ["sizes", "spare", "spare"]
    wrong = P.Provider("short", 3, function=lambda texts: [[1.0]] * len(texts))
    assert {tuple(r["vector"]) for r in P.embed(odd_texts(spark), wrong).collect()} == {(0, 0, 0)}
    assert P.embed(odd_texts(spark).limit(0), p).count() == 0


def test_deterministic_providers(spark):
    import hashlib

    texts = [r["text"] or "" for r in odd_texts(spark).orderBy("id").collect()]
    linear = [r["vector"] for r in P.embed(odd_texts(spark), P.LINEAR).orderBy("id").collect()]
    for t, v in zip(texts, linear):
        seed = int(hashlib.md5(t.encode()).hexdigest(), 16)
        assert v == [((seed + i) % 2_000_000) / 1_000_000.0 - 1.0 for i in range(1536)]
    hashed = [r["vector"] for r in P.embed(odd_texts(spark), P.HASHED).orderBy("id").collect()]
    for t, v in zip(texts, hashed):
        raw = np.array([int(hashlib.md5(f"{t}_{i}".encode()).hexdigest()[:8], 16) / (2**32 - 1) * 2 - 1 for i in range(384)])
        assert np.allclose(v, raw / np.linalg.norm(raw))
