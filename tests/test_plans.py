"""What the physical plans must show: filters and columns at the scan, one scan for all metrics, no Python in metric plans."""

import os
import re

import pytest

from quern.plans.registry import QUERIES
from quern.sources import readers as I

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_pushdown(spark):
    p = plan(I.read_split(spark, DATA, I.Source("tacred", "general"), "eval").select("example_id"))
    assert "EqualTo(dataset,tacred)" in p and "EqualTo(split,validation)" in p
    assert re.search(r"ReadSchema: struct<example_id:bigint,dataset:string,split:string>", p)


@pytest.mark.parametrize("name", ["agg_a02_micro_metrics", "agg_a07_evaluate_slice", "agg_a12_error_counts", "tab_r01_main_summary", "tab_r06_results_matrix"])
def test_metric_plans(spark, name):
    p = final(QUERIES[name](spark, DATA))
    assert "Python" not in p and "Arrow" not in p and "CartesianProduct" not in p and "NestedLoop" not in p
    assert "prompt_2_shot" not in p


def test_one_scan(spark):
    p = final(QUERIES["agg_a07_evaluate_slice"](spark, DATA))
    assert len(re.findall("Scan parquet", p)) == 1
    assert "prompt_0_shot" not in p


@pytest.mark.parametrize("name", [k for k in QUERIES if k.split("_")[0] in ("join", "agg", "tab", "set")])
def test_no_products(spark, name):
    p = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
