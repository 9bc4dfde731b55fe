"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from rosterlens import catalog
from rosterlens.operators import attrition, ranking, workforce


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drivers_scan_the_rows_once(tables):
    assert len(re.findall(r"FileScan parquet .*orders\.parquet", plan_of(attrition.attrition_drivers(tables.employee)))) == 1


def test_filters_and_columns_reach_the_scan(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    rows = tables.employee.where("department = 'BUILDING' and hire_date >= date'2000-01-01'").select("employee_id", "salary")
    lines = plan_of(rows).splitlines()
    orders = next(line for line in lines if "orders.parquet" in line)
    customer = next(line for line in lines if "customer.parquet" in line)
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in orders and "EqualTo(c_mktsegment,BUILDING)" in customer
    assert "o_orderpriority" not in orders and "o_orderstatus" not in orders and "c_name" not in customer


def test_customer_is_not_forced_to_broadcast(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(workforce.department_kpis(tables.employee))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 2


@pytest.mark.parametrize("name", ["w03_engagement_position", "w04_ntile_buckets", "w02_salary_position", "a47_profile_vs_peers"])
def test_no_single_partition_over_rows(spark, name):
    """Row-level results never pass through one task or an unkeyed window."""
    plan = plan_of(catalog.load()[name](spark, "/root/testdata/sf0.001"))
    for line in plan.splitlines():
        assert not ("Window [" in line and re.search(r"\], \[\]?$", line))
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_bucketed_total_orders_no_whole_group(spark):
    df = spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").alias("v"), F.lit(1).alias("w"))
    plan = plan_of(ranking.running_total(df, ["g"], "v", "w"))
    windows = re.findall(r"Window \[.*?windowspecdefinition\((.*?)specifiedwindowframe", plan)
    row_windows = [w for w in windows if "v#" in w]
    assert row_windows and all("__range" in w for w in row_windows)
