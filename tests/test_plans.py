"""Plan checks: filters reach the scan, partitions are pruned, and the
nearest-station / flagship plans contain no cartesian or nested-loop join."""

import contextlib
import io

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_date_filter_reaches_parquet_scan(spark):
    plan = _plan(E.queries()["filter_date_range"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_partition_filters_prune_folders(spark):
    plan = _plan(E.queries()["partitioned_roundtrip"](spark, SF))
    assert "PartitionFilters: [" in plan and "(year" in plan and "(month" in plan


def test_membership_filter_pushed_and_columns_pruned(spark):
    plan = _plan(E.queries()["filter_in"](spark, SF))
    assert "In(r_name, [AFRICA,AMERICA,ASIA,EUROPE])" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan


def test_no_cartesian_products(spark):
    from riskframe.operators.knn import knn_self
    from riskframe.plans import jobs
    for df in (jobs.bridge_fx(spark, SF), jobs.features_mobility_fx(spark, SF),
               knn_self(spark.range(200).selectExpr("id", "id % 13 AS a", "id % 7 AS b"), "id", ["a", "b"], 3,
                        materialize=False)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # The only nested-loop join is the broadcast single-row mean used for imputation
    plan = _plan(jobs.clean_fx(spark, SF))
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin Cross") <= 1
