"""Plan-shape regressions: properties of the physical plans that matter at scale."""

import pytest

from causeway.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"text_baseline_embeddings", "benchmark_orders",
                                                       "estimator_comparison_orders", "sample_estimators_orders",
                                                       "bow_documents", "ipw_logistic_orders", "aipw_orders",
                                                       "standardization_orders", "strat_standardization_orders"}))
def test_no_cartesian_product(spark, sf_dir, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["retail_features", "keep_first_documents", "ate_orders", "ipw_full_embeddings",
                                  "ipw_hybrid_embeddings", "trials_orders", "stratified_split_orders",
                                  "dialog_header_conversations"])
def test_hash_based_aggregation(spark, sf_dir, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, sf_dir))


def test_line_items_aggregated_before_their_join(spark, sf_dir):
    p = plan(QUERIES["retail_features"](spark, sf_dir))
    # the partial aggregate over the line-item scan comes before any join in the tree
    first_join = min(i for i in (p.find("BroadcastHashJoin"), p.find("SortMergeJoin")) if i >= 0)
    assert p.rfind("partial_sum(product_quantity") > first_join


def test_text_filters_run_after_the_spread(spark, sf_dir):
    """The one file of the small table is dealt out first; the expensive rules run behind that."""
    p = plan(QUERIES["rule_filter_documents"](spark, sf_dir))
    deal = p.find("Exchange hashpartitioning(doc_id")
    assert deal > 0 and 0 <= p.find("regexp_replace") < deal and "regexp_replace" not in p[deal:]


def test_no_text_in_a_shuffle_key(spark, sf_dir):
    import re
    for name in ("keep_first_documents", "post_sample_documents"):
        p = plan(QUERIES[name](spark, sf_dir))
        keys = re.findall(r"hashpartitioning\(([^)]*)\)", p)
        assert keys and not any("text" in k for k in keys), keys


def test_one_shuffle_for_a_dialog(spark, sf_dir):
    p = plan(QUERIES["dialog_render_conversations"](spark, sf_dir))
    assert p.count("Scan parquet") == 1 and "Join" not in p


def test_stitch_shuffles_comments_once_when_tables_are_large(spark, sf_dir):
    import re
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as if every table were large
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(QUERIES["thread_stitch_conversations"](spark, sf_dir))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # the comment rows are hash-partitioned by thread key once; the join back to the stitched
    # posts must not re-partition them by (submission, thread key)
    assert not re.search(r"Exchange hashpartitioning\((sub_id#\d+L, thread_key|thread_key#\d+L, sub_id)", p)
    assert "SortMergeJoin" in p and "CartesianProduct" not in p
