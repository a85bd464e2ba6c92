"""Plan shapes the design relies on (checked on the executed plans)."""

import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from tillroll.operators import breakdowns as B
from tillroll.operators.insights import insights
from tillroll.operators.kpis import kpi_card
from tillroll.sources.sales import load_sales


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sales(spark):
    return load_sales(spark, SF_SMALL)


def test_kpi_card_is_one_scan(sales):
    plan = executed(kpi_card(sales))
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan


def test_insights_are_one_scan(sales):
    plan = executed(insights(sales))
    assert plan.count("FileScan parquet") == 1


def test_top_k_is_take_ordered(sales):
    plan = sales.transform(B.top_products)._jdf.queryExecution().sparkPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_reads_only_needed_columns(sales):
    plan = executed(B.revenue_by_category(sales))
    read = plan.split("ReadSchema: ")[1].split("\n")[0] if "ReadSchema: " in plan else plan
    assert "category" in read and "revenue" in read and "customer_name" not in read


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = executed(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_star_join_broadcasts_only_fixed_dimensions(spark):
    from tillroll.sources.sales import sales_view
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sales_view(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # nation x region are hinted; orders, customer, part shuffle when AQE may not broadcast
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("BroadcastHashJoin") == 2
