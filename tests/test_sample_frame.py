"""Operator values on the four-row frame (hand-derived, see FIXTURES.md §1)."""

import pytest
from conftest import one

from tillroll.operators import breakdowns as B
from tillroll.operators.cleaning import validate_columns
from tillroll.operators.forecast import forecast, forecast_confidence, trend_fit
from tillroll.operators.insights import insights, kpi_brief
from tillroll.operators.kpis import kpi_card
from tillroll.plans.export import report_kpi_table, workbook_summary
from tillroll.sources.sinks import write_csv


def test_required_columns(sample):
    assert validate_columns(sample) == (True, [])


def test_kpi_card(sample):
    k = one(kpi_card(sample))
    assert k["total_revenue"] == 2150.0
    assert k["total_orders"] == 4
    assert k["aov"] == 537.5
    assert k["top_region"] == "North"
    assert k["top_category"] == "Electronics"
    assert k["cancellation_rate"] == 25.0
    assert k["return_rate"] == 25.0
    assert k["returning_customer_rate"] == pytest.approx(100 / 3)
    assert k["gross_profit"] == pytest.approx(645.0)
    assert k["profit_margin"] == pytest.approx(30.0)
    assert k["avg_basket_size"] == 1.25
    assert k["best_sales_month"] == "2023-01"
    assert k["worst_sales_month"] == "2023-02"
    assert k["monthly_growth"] == pytest.approx(900.0)


def test_forecast_one_period(sample):
    rows = forecast(sample, periods=1).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert r == {"period": "2023-04", "predicted_revenue": 666.67, "top_product": "Laptop",
                 "predicted_product_demand": 1, "top_category": "Electronics",
                 "predicted_category_revenue": 666.67}


def test_trend_fit(sample):
    f = one(trend_fit(sample))
    assert f["n_months"] == 3
    assert f["slope"] == pytest.approx(-25.0)
    assert f["intercept"] == pytest.approx(741.6666666, rel=1e-9)


def test_forecast_confidence(sample):
    c = one(forecast_confidence(sample))
    assert c["month_count"] == 3 and c["confidence"] == "Low" and c["has_enough_history"]


def test_insights(sample):
    rows = [r.asDict() for r in insights(sample).collect()]
    texts = [r["text"] for r in rows]
    assert any("Total revenue" in t for t in texts)
    assert texts[0] == "Total revenue across all transactions is Rs 2,150.00 with 4 orders processed."
    cats = [r["category"] for r in rows]
    assert cats == sorted(cats, key=["Revenue Insights", "Product Insights", "Customer Insights",
                                     "Risk Alerts"].index)
    assert "The Electronics category leads revenue with Rs 2,000.00 (93.0% of total)." in texts
    assert "'Laptop' is the best-selling product, generating Rs 2,000.00." in texts
    assert "Customers are purchasing an average of 1.2 items per order." in texts
    assert "Customer retention is strong at 33.3%. Loyalty programs are highly effective." in texts
    assert "The preferred payment method is Credit Card (2 transactions)." in texts
    assert "South region is experiencing an abnormal cancellation rate of 100.0%." in texts
    risk = [r for r in rows if r["category"] == "Risk Alerts"]
    assert [r["severity"] for r in risk] == ["critical", "critical", "critical"]
    assert [r["position"] for r in risk] == [0, 1, 2]


def test_kpi_brief(sample):
    text = one(kpi_brief(sample))["brief"]
    lines = text.split("\n")
    assert lines[:8] == ["Revenue: Rs 2,150.00", "Orders: 4", "Average Order Value: Rs 537.50",
                         "Cancellation Rate: 25.00%", "Return Rate: 25.00%",
                         "Returning Customer Rate: 33.33%", "Top Region: North", "Top Category: Electronics"]
    assert "Top Products:" in lines and "- Laptop: Rs 2,000.00" in lines
    assert "- Credit Card: 2" in lines


def test_breakdowns_sum_to_total(sample):
    total = one(kpi_card(sample))["total_revenue"]
    for df in (B.monthly_revenue(sample), B.revenue_by_category(sample), B.revenue_by_region(sample),
               B.daily_revenue(sample)):
        assert sum(r["revenue"] for r in df.collect()) == pytest.approx(total)
    assert [r["product"] for r in B.top_products(sample).collect()] == ["Laptop", "Keyboard", "Mouse"]
    assert sum(r["revenue"] for r in B.region_category_long(sample).collect()) == pytest.approx(total)


def test_region_category_zero_cells(sample):
    cells = {(r["region"], r["category"]): r["revenue"] for r in B.region_category_long(sample).collect()}
    assert len(cells) == 6
    assert cells[("South", "Electronics")] == 0.0 and cells[("East", "Electronics")] == 1000.0


def test_csv_export_contains_rows(sample, tmp_path):
    out = write_csv(sample, str(tmp_path / "export"))
    text = "".join(p.read_text() for p in (tmp_path / "export").glob("*.csv"))
    assert "Alice" in text and out.endswith("export")


def test_export_tables(sample):
    card = kpi_card(sample)
    summary = [r.asDict() for r in workbook_summary(card).orderBy("position").collect()]
    assert summary[0]["metric"] == "Total Revenue (Rs)" and summary[0]["value_number"] == 2150.0
    assert summary[3]["value_text"] == "North"
    table = {r["metric"]: r["value"] for r in report_kpi_table(card).collect()}
    assert table["Total Revenue"] == "Rs 2,150.00" and table["Order Cancellation Rate"] == "25.00%"
