"""Registered queries: contract and plan shape."""

import pytest

import __spark_entry__ as entry
from hearsay.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["author", "n_anti", "total"] and df.count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(catalog.rows()[name] for name in catalog.queries())


@pytest.mark.parametrize("name", ["author_class_db", "eda_stats_c2", "crosspost_parents", "nc_score",
                                  "alpha_directed", "preprocess_text", "argmax_label", "missing_slices"])
def test_no_cartesian_product_and_no_python(spark, data_dir, name):
    text = plan(entry.queries()[name](spark, data_dir))
    assert "CartesianProduct" not in text and "ArrowEvalPython" not in text
    assert "BatchEvalPython" not in text


def test_pruning_and_pushdown(spark, data_dir):
    text = plan(entry.queries()["lookup_urls"](spark, data_dir))
    assert "l_tax" not in text and "l_returnflag" not in text
    scored = plan(entry.queries()["score_batches"](spark, data_dir))
    assert "ArrowEvalPython" in scored


def test_landed_slices_prune_partitions_and_row_groups(spark, data_dir):
    text = plan(entry.queries()["partitioned_slice"](spark, data_dir))
    assert "PartitionFilters: [isnotnull(subreddit" in text and "(subreddit" in text
    assert "GreaterThanOrEqual(created_utc" in text and "LessThanOrEqual(created_utc" in text
