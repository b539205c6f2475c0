"""The near-duplicate stage of the pipeline against brute force over planted copies."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def kept(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def planted():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, likeness = [], []
    for changes in range(1, 10):
        for _ in range(8):
            base = [rng.choice(words) for _ in range(230)]
            copy = list(base)
            for at in rng.sample(range(0, 230, 6), changes):
                copy[at] = "ÉTÉ" + str(at)
            rows += [(len(rows) + k, " ".join(t), "en", "s", 9) for k, t in enumerate((base, copy))]
            likeness.append(jaccard(shingle_set(rows[-1][1]), shingle_set(rows[-2][1])))
    rows += [(len(rows), None, "en", "s", 0), (len(rows) + 1, " ", "en", "s", 1), (len(rows) + 2, "One two", "en", "s", 7), (len(rows) + 3, "one  TWO", "en", "s", 8)]
    return rows, likeness


def test_stage_finds_copies_at_four_fifths(spark):
    import corpus_pipeline as P

    rows, likeness = planted()
    for low, high in ((0, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 0.96)):
        assert sum(low <= x < high for x in likeness) >= 8
    want = kept(rows)
    assert len(want) < len(rows) - 40
    got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_stage_on_the_tables(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = kept([tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, sf_dir).collect()) == want


def test_stage_keeps_clashing_columns_and_repeated_rows(spark):
    from marlstone.llm.near_copies import keep_one

    rows = [(2, "a b c d e f g", "mine", "fp0"), (1, "a b c d e f g", "other", "fp1"), (1, "a b c d e f g", "again", "fp2"), (None, "a b c d e f g", "null", "fp3"), (3, None, "none", "fp4"), (None, "q r s t u v", "alone", "fp5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, fp string").withColumn("file", F.lit("f")).withColumn("digest", F.lit("d"))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/clash.parquet"
    docs.coalesce(1).write.mode("overwrite").parquet(path)
    for table in (docs.coalesce(1), spark.read.parquet(path)):
        got = sorted(keep_one(spark, table).collect(), key=lambda r: r["fp"])
        assert [tuple(r) for r in got] == [(1, "a b c d e f g", "other", "fp1", "f", "d"), (3, None, "none", "fp4", "f", "d"), (None, "q r s t u v", "alone", "fp5", "f", "d")]
    assert keep_one(spark, docs.limit(0)).count() == 0
