from marlstone.llm import quality_rules as R


def test_target_join_has_one_plan_at_any_size(spark, sf_dir):
    """Few labels are no broadcast: a plan that changes as they grow makes disk jump."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    text = R.fit_weights(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id" in text and "BroadcastHashJoin [doc_id" not in text
