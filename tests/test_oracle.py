"""Registered queries against their SQL on the smallest tables."""

import pytest

from logfault.plans import ORACLE, QUERIES
from logfault.plans.check import compare

# One query per way of computing; the check tool runs all of them.
FAST = ["a01_csv_scan", "a03_stage_sources", "a06_fold_files", "b02_distinct_rows", "b05_fill_constant",
        "b06_mean_imputation", "c02_normalise", "c03_mask", "c07_ceil_bucket", "d03_asof_tail", "d04_bounded_asof",
        "d06_interval_latest", "d07_look_ahead", "e05_share_columns_fold_safe", "e07_tail_statistics",
        "e08_top_values", "e11_skew_kurtosis", "e17_profile_overlap", "e19_exclusion_count",
        "f08_longest_run_strict", "g02_benford", "g09_sample_entropy", "h02_template_match",
        "h12_tfidf_mean_vector", "h16_cosine_to_centroids", "h20_untailed_terms", "i02_stratified_folds",
        "i03_group_folds", "i12_class_report", "h09_svd_audit", "h10_word_embedding", "i13_oversample_audit", "i16_feature_assembly"]


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, small, name):
    problem, rows, _, _ = compare(spark, small, name, QUERIES[name], ORACLE[name])
    assert problem is None
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 119


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
