"""The hash vector's norm is computed once for a text, not once for each of its numbers."""

from pyspark.sql import functions as F

from marlstone.operators.corpus import hash_vector


def test_numbers_are_divided_by_a_norm_at_hand(spark):
    v = spark.createDataFrame([("a",)], "text string").select(hash_vector(F.col("text")).alias("v"))
    plan = v._jdf.queryExecution().analyzed().toString().lower()
    assert "sqrt(aggregate(" in plan and "/ sqrt(" not in plan
    assert abs(sum(x * x for x in v.first()["v"]) - 1) < 1e-9
