"""What the near-duplicate stage moves and leaves behind."""

import re

from pyspark.sql import functions as F

from marlstone.llm import common


def test_documents_move_once(spark, monkeypatch):
    from marlstone.llm import near_copies as N

    rows = [(k, " ".join(f"w{(k // 3) * 50 + j}" for j in range(40)), "en", "s", 9) for k in range(60)]
    path = f"{common.new_path(spark, 'moves')}.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(path)
    plans, bucketed = [], N.bucketed

    def seen(spark, df, *names):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = bucketed(spark, df, *names)
        files = spark.read.parquet(out[2]).select(F.input_file_name()).distinct().count()
        assert files <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        return out

    monkeypatch.setattr(N, "bucketed", seen)
    out = N.keep_one(spark, spark.read.parquet(path))
    assert [r["doc_id"] for r in out.select("doc_id").orderBy("doc_id").collect()] == list(range(0, 60, 3))
    (texts,) = [p for p in plans if re.search(r"AS doc#", p)]
    logical = texts[texts.rindex("Join") :]
    assert len(re.findall("RepartitionByExpression", texts)) == 1 and "RepartitionByExpression" in logical
    N.forget(spark)


def test_tasks_of_written_tables_get_bounded_batches_and_settings_stay(spark):
    def heights(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    before = {k: spark.conf.get(k, None) for k in common.WRITING}
    sizes = spark.range(0, 4000, 1, 2).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(heights, "n long")
    written, path = common.materialize(spark, sizes, "sizes")
    assert max(r["n"] for r in written.collect()) * 10_000 < 2 * 4 * 2**20
    assert {k: spark.conf.get(k, None) for k in common.WRITING} == before
    common.remove(spark, path)
