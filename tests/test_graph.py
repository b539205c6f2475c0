import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph as G


def shuffled(spark):
    """Rows that stages have written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize(("denominator", "floor"), [("min", 0.4), ("union", 0.2)])
def test_shared_terms_of_narrow_and_wide_sets(spark, denominator, floor):
    rng = random.Random(3)
    sets = {(g, k): frozenset(rng.randrange(60) for _ in range(rng.choice((1, 2, 3, 5, 8, G.WIDE, 2 * G.WIDE)))) for g in (0, 1) for k in range(40)}
    df = spark.createDataFrame([(g, k, list(t)) for (g, k), t in sets.items()], "g int, k int, t array<int>")
    want = set()
    for (g, a), x in sets.items():
        for (h, b), y in sets.items():
            base = min(len(x), len(y)) if denominator == "min" else len(x | y)
            if g == h and a < b and len(x & y) / base > floor:
                want.add((g, a, b, round(len(x & y) / base, 6)))
    got = [tuple(r) for r in G.shared_terms(df, ["g"], "k", "t", floor, denominator).select("g", "a", "b", "overlap").collect()]
    assert len(got) == len(want) and set(got) == want


def test_pairs_do_not_move(spark):
    """300 sets share a term: 44 850 pairs, which are verified where they meet."""
    df = spark.range(300).select(F.col("id").alias("k"), F.array(F.lit(-1), F.col("id")).alias("t"))
    before, kept = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert G.shared_terms(df, [], "k", "t", 0.4).count() == 44850
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert shuffled(spark) - before < 10000
