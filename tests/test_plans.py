"""What the optimizer makes of some queries: pruned columns, pushed filters, no nested loops, no Python where none is needed."""

import os
import re

import pytest

from curatrix.plans import bridge, catalogue

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "eligibility_filter")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(c_acctbal,0", text) and "c_name" not in text


@pytest.mark.parametrize("name", ["binary_metrics", "oof_plan", "hard_errors", "source_balanced_epoch", "exact_survivors", "overlap_audit", "dual_policy", "request_validation"])
def test_no_python_and_no_nested_loops_over_tables(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)
    for node in re.findall(r"BroadcastNestedLoopJoin[^\n]*", text):
        assert "Cross" in node or "Inner" in node  # one-row tables only: totals and quotas


def test_plans_read_only_the_columns_they_need(spark):
    text = plan(spark, "value_counts")
    assert re.search(r"ReadSchema: struct<source:string>", text)


@pytest.mark.parametrize("name", ["component_survivors", "protected_survivors"])
def test_estimates_of_survivors_stay_small(spark, name):
    """A size of a few joins since the last cut, not of all rounds."""
    size = catalogue.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size.bit_length() < 2000


def test_texts_are_hashed_below_the_join_of_labels(spark):
    plan = bridge.manifest(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ArrowEvalPython")
