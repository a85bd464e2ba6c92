"""Edge frames the reference does not test (FIXTURES.md §7)."""

import pytest
from conftest import one

from tillroll.operators import breakdowns as B
from tillroll.operators.filters import SalesFilter, apply_filters
from tillroll.operators.forecast import forecast
from tillroll.operators.insights import insights, kpi_brief
from tillroll.operators.kpis import DEFAULTS, kpi_card

SCHEMA = ("order_id bigint, customer_name string, product string, category string, region string, "
          "quantity double, revenue double, payment_method string, order_status string, order_date string")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_empty_frame_defaults(spark):
    empty = frame(spark, [])
    assert one(kpi_card(empty)) == DEFAULTS
    rows = insights(empty).collect()
    assert [(r["category"], r["severity"], r["text"]) for r in rows] == [
        ("Risk Alerts", "critical", "No data available to generate insights.")]
    assert forecast(empty).count() == 0
    assert B.monthly_revenue(empty).count() == 0
    brief = one(kpi_brief(empty))["brief"]
    assert brief.count("- N/A") == 5


@pytest.mark.parametrize("missing", ["order_id", "region", "category", "customer_name", "quantity",
                                     "revenue", "order_status", "order_date"])
def test_missing_column(spark, sample, missing):
    df = sample.drop(missing)
    k = one(kpi_card(df))
    if missing == "order_id":
        assert k["total_orders"] == 4
    if missing == "region":
        assert k["top_region"] == "N/A"
    if missing == "revenue":
        assert k["total_revenue"] == 0.0 and k["best_sales_month"] == "N/A"
    if missing == "order_status":
        assert k["cancellation_rate"] == 0.0
    if missing == "order_date":
        assert k["monthly_growth"] == 0.0 and forecast(df).count() == 0
    insights(df).collect()
    kpi_brief(df).collect()


def test_null_keys_are_dropped(spark):
    df = frame(spark, [(1, None, "A", None, None, 1.0, 10.0, None, None, "2023-01-01"),
                       (2, "x", "B", "C1", "R1", 1.0, 5.0, "Card", "Delivered", "2023-01-02")])
    k = one(kpi_card(df))
    assert k["top_region"] == "R1" and k["top_category"] == "C1"
    assert k["returning_customer_rate"] == 0.0
    assert [r["region"] for r in B.revenue_by_region(df).collect()] == ["R1"]
    counts = {r["label"]: r["value"] for r in B.top_items(df, "payment_method", None).collect()}
    assert counts == {"Unknown": 1.0, "Card": 1.0}


def test_ties_pick_smallest_key(spark):
    df = frame(spark, [(1, "a", "P", "C", "West", 1.0, 50.0, "X", "Delivered", "2023-01-01"),
                       (2, "b", "Q", "C", "East", 1.0, 50.0, "X", "Delivered", "2023-02-01")])
    k = one(kpi_card(df))
    assert k["top_region"] == "East"
    assert k["best_sales_month"] == "2023-01" and k["worst_sales_month"] == "2023-01"


def test_months_with_gap_and_few_months(spark):
    one_month = frame(spark, [(1, "a", "P", "C", "R", 1.0, 10.0, "X", "Delivered", "2023-01-01")])
    assert one(kpi_card(one_month))["monthly_growth"] == 0.0
    two = frame(spark, [(1, "a", "P", "C", "R", 1.0, 10.0, "X", "Delivered", "2023-01-01"),
                        (2, "a", "P", "C", "R", 1.0, 15.0, "X", "Delivered", "2023-05-01")])
    assert one(kpi_card(two))["monthly_growth"] == pytest.approx(50.0)
    assert forecast(two).count() == 0
    gap = two.union(frame(spark, [(3, "a", "P", "C", "R", 1.0, 20.0, "X", "Delivered", "2023-09-01")]))
    periods = [r["period"] for r in forecast(gap).collect()]
    assert periods == ["2023-10", "2023-11", "2023-12"]  # gaps collapse for the index only


def test_zero_revenue_and_null_quantity(spark):
    df = frame(spark, [(1, "a", "P", "C", "R", None, 0.0, "X", "Delivered", "2023-01-01"),
                       (1, "a", "P", "C", "R", None, 0.0, "X", "Delivered", "2023-02-01")])
    k = one(kpi_card(df))
    assert k["total_revenue"] == 0.0 and k["profit_margin"] == 0.0 and k["aov"] == 0.0
    assert k["avg_basket_size"] == 0.0 and k["monthly_growth"] == 0.0
    assert k["returning_customer_rate"] == 100.0


def test_cost_column_switches_profit(spark):
    df = frame(spark, [(1, "a", "P", "C", "R", 1.0, 100.0, "X", "Delivered", "2023-01-01", 60.0)],
               SCHEMA + ", cost double")
    k = one(kpi_card(df))
    assert k["gross_profit"] == 40.0 and k["profit_margin"] == 40.0


def test_product_search_is_regex_and_lowered(spark):
    df = frame(spark, [(1, "a", "USB-C (2m)", "C", "R", 1.0, 1.0, "X", "D", "2023-01-01"),
                       (2, "a", "usb hub", "C", "R", 1.0, 1.0, "X", "D", "2023-01-01"),
                       (3, "a", None, "C", "R", 1.0, 1.0, "X", "D", "2023-01-01")])
    assert apply_filters(df, SalesFilter(product_search="  USB.C ")).count() == 1
    assert apply_filters(df, SalesFilter(product_search=r"\(2M\)")).count() == 1  # lowered pattern
    with pytest.raises(Exception):
        apply_filters(df, SalesFilter(product_search="(unclosed"))


def test_end_date_is_midnight(spark):
    df = frame(spark, [(1, "a", "P", "C", "R", 1.0, 1.0, "X", "D", "2023-01-31 00:00:00"),
                       (2, "a", "P", "C", "R", 1.0, 1.0, "X", "D", "2023-01-31 10:30:00"),
                       (3, "a", "P", "C", "R", 1.0, 1.0, "X", "D", "2023-02-01 00:00:00")])
    got = apply_filters(df, SalesFilter(date_start="2023-01-01", date_end="2023-01-31"))
    assert sorted(r["order_id"] for r in got.collect()) == [1]


def test_group_of_null_revenues_counts_as_zero(spark):
    df = frame(spark, [(1, "a", "P", "C", "N", 1.0, None, "X", "D", "2023-01-01"),
                       (2, "a", "P", "C", "S", 1.0, 10.0, "X", "D", "2023-01-01")])
    assert one(kpi_card(df))["top_region"] == "S"


def test_region_cancellation_alert_without_revenue(spark, sample):
    texts = [r["text"] for r in insights(sample.drop("revenue")).collect()]
    assert "South region is experiencing an abnormal cancellation rate of 100.0%." in texts
    assert not any("strongest market" in t for t in texts)


def test_forecast_without_periods_is_empty(sample):
    assert forecast(sample, periods=0).count() == 0
    assert forecast(sample, periods=2).count() == 2


def test_filter_from_request_params(sample):
    params = {"date_start": "", "date_end": None, "category": [], "region": ["North"],
              "payment_method": None, "order_status": None, "revenue_min": "", "revenue_max": "500",
              "product_search": None, "page": "2"}
    spec = SalesFilter.from_params(params)
    assert sorted(r["order_id"] for r in apply_filters(sample, spec).collect()) == [3]
