"""Plans have the shape that scale needs."""

import pytest

from emberline.plans import catalog


@pytest.mark.parametrize("name", ["risk_radius", "segment_risk", "neardup_pairs", "rotating_ids", "geofence_subscribers"])
def test_no_nested_loop_joins(name, spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["reputation_fold", "sos_state", "token_bucket", "hash_chain", "neardup_accounts", "funnel_metrics", "public_feed", "type_detect"])
def test_no_row_python(name, spark, sf_dir):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_columns_are_pruned(spark, sf_dir):
    plan = catalog.QUERIES["upsert_latest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_filters_are_pushed(spark, sf_dir):
    plan = catalog.QUERIES["point_lookup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,42)" in plan
